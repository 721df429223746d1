import numpy as np
import pytest

from docsleuth.operators import blocks, cases, clusters, entities, identity, reconcile, reports
from docsleuth.sources import shared


def test_clusters_of_any_depth(spark):
    """A chain of 200 records is one cluster; null and empty values tie nothing; a value that all have ties all."""
    chain = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(200)] + [(900, None, ""), (901, None, ""), (None, "a0", "b0")]
    df = spark.createDataFrame(chain, "id long, x string, y string")
    found = {r["node"]: r["cluster"] for r in clusters.shared_clusters(df, "id", ["x", "y"]).collect()}
    assert found == {i: 0 for i in range(200)} | {900: 900, 901: 901}
    same = spark.createDataFrame([(i, "hot") for i in range(500)], "id long, x string")
    assert {r["cluster"] for r in clusters.shared_clusters(same, "id", ["x"]).collect()} == {0}
    assert clusters.shared_clusters(df.limit(0), "id", ["x"]).count() == 0


def test_copy_move_compares_all(spark):
    """Descriptors that differ in their first bits alone are found; against a plain loop."""
    rng = np.random.default_rng(0)
    rows = []
    for image in range(3):
        for k in range(30):
            words = [int(x) for x in rng.integers(0, 1 << 60, 4)] if k % 3 else [1 << (k % 60), 0, 0, 0]
            rows.append((image, k, words, float(rng.uniform(0, 100)), float(rng.uniform(0, 100)), 141.0))
    df = spark.createDataFrame(rows, "image int, k int, d array<long>, x double, y double, diagonal double")
    want = {}
    for image in range(3):
        own = [r for r in rows if r[0] == image]
        n = 0
        for a in own:
            near = sorted((sum((p ^ q).bit_count() for p, q in zip(a[2], b[2], strict=True)), a[1] != b[1], b[1], b) for b in own)[:3]
            n += sum(d <= 40 and other and np.hypot(a[3] - b[3], a[4] - b[4]) >= 0.15 * 141 for d, other, _, b in near)
        if n:
            want[image] = min(100.0, n / 2)
    assert {r["image"]: r["copy_move_score"] for r in blocks.copy_move(df, "image", "k", "d", "x", "y", "diagonal").collect()} == want


def test_upserts(spark):
    current = spark.createDataFrame([("t::BT-1", "t", "BT-1", "seen", None, None)], "case_key string, document_type string, entity_ref string, status string, disposition string, priority string")
    changes = spark.createDataFrame([("t::BT-1", 1, None, "open", None), ("t::BT-1", 2, None, "cleared", None), ("a::b::BT-2", 1, "triage", None, None), ("plain", 1, None, None, "high"), ("a::BT-9", 1, None, None, None)], "case_key string, ts long, status string, disposition string, priority string")
    known = spark.createDataFrame([("BT-2",)], "entity_ref string")
    found = {r["case_key"]: tuple(r)[1:] for r in cases.upserted(current, changes, known, ["status", "disposition", "priority"]).collect()}
    assert found == {"t::BT-1": ("t", "BT-1", "seen", "cleared", None), "a::b::BT-2": ("a::b", "BT-2", "triage", "open", "normal"), "plain": ("", None, "new", "open", "high"), "a::BT-9": ("a", None, "new", "open", "normal")}
    notes = spark.sql("SELECT 'c' AS case_key, 1 AS ts, '' AS author, '  x ' AS note UNION ALL SELECT 'c', 2, 'me', '   '")
    assert [tuple(r) for r in cases.noted(notes).collect()] == [("c", 1, "system", "x")]


def test_roles(spark):
    rows = [("generic", {"title": "TO WHOMSOEVER"}, {}, "letter"), ("generic", {"title": "Form-16"}, {}, "form16"), ("generic", {}, {"tan_of_employer": ["x"]}, "form16"), ("generic", {"title": "other"}, {}, None), ("invoice", {"annual_ctc": "5"}, {}, None), ("gift_letter", {}, {}, "gift")]
    df = spark.createDataFrame([(t, k, n, w) for t, k, n, w in rows], "t string, k map<string,string>, n map<string,array<string>>, w string")
    assert df.where(~reconcile.role(df["t"], df["k"], df["n"]).eqNullSafe(df["w"])).count() == 0


def test_largest_face_and_names(spark):
    faces = spark.sql("SELECT 1 AS frame, 'a' AS who, named_struct('x1', 0D, 'y1', 0D, 'x2', 2D, 'y2', 2D) AS bbox UNION ALL SELECT 1, 'b', named_struct('x1', 0D, 'y1', 0D, 'x2', 3D, 'y2', 2D)")
    assert identity.largest_face(faces, ["frame"]).first()["who"] == "b"
    scans = spark.sql("SELECT 1 AS doc_id, 'E1' AS entity_ref, CAST(NULL AS STRING) AS document_type, 1 AS generated_at UNION ALL SELECT 2, 'gone', 'p', 2")
    people = spark.sql("SELECT 'E1' AS entity_ref, 'A' AS first_name, CAST(NULL AS STRING) AS last_name")
    assert [(r["entity_ref"], r["entity_name"], r["case_key"]) for r in reports.recent_scans(scans, people).orderBy("doc_id").collect()] == [("E1", "A", "generic::E1"), ("unlinked", "—", "p::unlinked")]
    info = entities.document_information(spark.sql("SELECT 1 AS doc_id, 'E1' AS entity_ref, 't' AS document_type, map('a', 'b') AS key_fields UNION ALL SELECT 2, NULL, 't', NULL"))
    assert [(r["doc_id"], r["extracted_data"]) for r in info.collect()] == [(1, {"a": "b"})]


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    """Without spark.checkpoint.dir there is no folder that executors share, unless Spark is local."""

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(RuntimeError):
        shared.shared_dir(type("Session", (), {"sparkContext": Context()})())
