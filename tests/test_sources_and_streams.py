"""Sources, sinks, the stream monitor, and operators with results that SQL does not show."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from driftloom.functions import text
from driftloom.operators import contracts, extraction, graph_queries, lineage, planning, statistics, views
from driftloom.sources import corpora
from driftloom.streaming.monitor import violation_windows


def test_docred(spark, tmp_path):
    doc = {"title": "A b/c", "sents": [["Ann", "met", "Bob", "."]], "vertexSet": [[{"name": "Ann", "type": "PER", "sent_id": 0, "pos": [0, 1]}, {"name": "Annie", "type": "PER", "sent_id": 0, "pos": [0, 1]}], [{"name": "Bob", "type": "PER", "sent_id": 0, "pos": [2, 3]}]], "labels": [{"h": 0, "t": 1, "r": "P1", "evidence": [0]}, {"h": 0, "t": 9, "r": "P2", "evidence": []}]}
    (tmp_path / "d.json").write_text(json.dumps([doc]))
    docs = corpora.read_docred(spark, str(tmp_path / "d.json"))
    assert [r.document_id for r in docs.collect()] == ["docred-dev-000000-A_b_c"]
    assert [(r.canonical_name, r.aliases) for r in corpora.entities(docs).orderBy("entity_id").collect()] == [("Ann", ["Ann", "Annie"]), ("Bob", ["Bob"])]
    assert corpora.sentence_rows(docs).first().text == "Ann met Bob."
    assert [(r.head_name, r.tail_name, r.tail_entity_id) for r in corpora.gold_edges(docs).orderBy("gold_edge_id").collect()] == [("Ann", "Bob", "docred-dev-000000-A_b_c::e1"), ("Ann", "#9", None)]


def test_pubtator(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1|t|Title here\n1|a|Body.\n1\t0\t5\tTitle\tChemical\tD1|D2\n1\t6\t10\there\tDisease\t-1\n1\tCID\tD1\tD2\n\n2|t|Other\n2|a|B\n")
    docs = corpora.read_pubtator(spark, str(tmp_path / "p.txt"))
    rows = docs.orderBy("pmid").collect()
    assert [(r.pmid, r.title, len(r.mentions), len(r.relations)) for r in rows] == [("1", "Title here", 2, 1), ("2", "Other", 0, 0)]
    assert sorted(r.mesh for r in corpora.mesh_clusters(docs).collect()) == ["D1", "D2"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "l.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id TEXT PRIMARY KEY, n INTEGER, x REAL)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(f"k{i}", i, i / 2) for i in range(25)])
    spark.dataSource.register(corpora.SqliteSource)
    rows = spark.read.format("sqlite").option("path", path).option("table", "t").option("partitions", "3").load()
    assert rows.agg(F.count("*"), F.sum("n"), F.sum("x")).first()[:] == (25, 300, 150.0)


def test_checkpoint_and_sinks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc":"a","status":"ok"}\n{"doc":"b","status":"ok"}\n{"doc":"a","status":"failed"}\n')
    rows = corpora.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "doc string, status string", ["doc"])
    assert sorted((r.doc, r.status) for r in rows.collect()) == [("a", "failed"), ("b", "ok")]
    corpora.write_manifest(str(tmp_path / "m.json"), {"b": 1})
    with pytest.raises(FileExistsError):
        corpora.write_manifest(str(tmp_path / "m.json"), {})
    rows.write.parquet(str(tmp_path / "old"))
    corpora.write_upsert(spark.createDataFrame([("a", "new"), ("c", "ok")], "doc string, status string"), str(tmp_path / "old"), ["doc"], str(tmp_path / "next"))
    assert sorted((r.doc, r.status) for r in spark.read.parquet(str(tmp_path / "next")).collect()) == [("a", "new"), ("b", "ok"), ("c", "ok")]


def test_stream_monitor(spark, tmp_path):
    rows = spark.createDataFrame([(f"2026-01-01 00:{m:02d}:00", f"r{m % 30}", "schema", m / 60) for m in range(60)], "t string, run_id string, cause_family string, drift double").select(F.to_timestamp("t").alias("created_at"), "run_id", "cause_family", "drift")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = violation_windows(stream, 0.5, length="30 minutes").writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM seen").first()[0] == 30


def test_text_functions(spark):
    one = spark.createDataFrame([(" \tÀb c\xa0", 'Here: ```x {"a": [1, 2,], } done', "a::b::e3", "Dr. X met Y. Then Z left! Ok.")], "n string, j string, i string, s string")
    r = one.select(text.name_key(F.col("n")).alias("n"), text.relation_key(F.col("n")).alias("k"), text.lenient_json(F.col("j")).alias("j"), text.parent_id(F.col("i")).alias("p"), text.local_id(F.col("i")).alias("l"), text.digest_uint64(F.col("i")).alias("u"), F.size(text.sentences(F.col("s"))).alias("c")).first()
    assert (r.n, r.k, r.p, r.l, r.c) == ("àb c", "àb_c", "a::b", "e3", 3) and json.loads(r.j) == {"a": [1, 2]} and r.u > 0


def test_extraction(spark):
    raw = spark.createDataFrame([("e", '```json\n{"edges":[{"subject":" A ","relation":"r","object":"B","evidence_sentences":[1,9],"confidence":"0.5"},{"subject":"","relation":"r","object":"B"}]}\n```', 3)], "event_id string, response string, n int")
    edges = extraction.normalise_edges(raw, F.col("n")).collect()
    assert [(e.s, e.r, e.o, e.evidence, e.confidence) for e in edges] == [("A", "r", "B", [1], 0.5)]
    rows = spark.createDataFrame([("d", "A", "r", "B", [1]), ("d", "A", "r", "Z", [1]), ("d", "A", "q", "B", [1]), ("d", "A", "r", "B", []), ("d", None, "r", "B", [1])], "doc string, s string, r string, o string, evidence array<int>")
    names = spark.createDataFrame([("d", "A"), ("d", "B")], "doc string, name string")
    assert sorted(str(r.reason) for r in extraction.reject_reasons(rows, names, ["r"]).collect()) == ["None", "entity", "evidence", "relation", "shape"]
    masks = {r.level: r.text for r in extraction.mask_nested(spark.createDataFrame([("d", "a b  c d")], "doc string, text string"), (0.25, 0.5, 1.0)).collect()}
    assert masks[1.0] == "[MASK] [MASK]  [MASK] [MASK]" and masks[0.25].count("[MASK]") == 1 and all(a == b for a, b in zip(masks[0.5].split(), masks[0.25].split(), strict=True) if b == "[MASK]")


def test_planners(spark):
    rows = spark.createDataFrame([("d", f"i{i}", "ABC"[i % 3], "prompt", "mask", float(i), float(i % 3), float(i), True) for i in range(12)], "document_id string, intervention_id string, cause_family string, target_type string, operator string, estimated_cost double, family_yield double, group_yield double, violated boolean")
    got = planning.adaptive(rows, 6).collect()
    assert len(got) == 6 and [r.intervention_id for r in sorted(got, key=lambda r: r.rank)][:2] == ["i0", "i1"]  # the cheapest of the first two families
    assert [r.cause_family for r in planning.adaptive(rows, 2).orderBy("rank").collect()] == ["C", "C"]
    assert planning.exhaustive(rows, 1).count() == 12 and planning.cheapest_first(rows, 3).agg(F.max("estimated_cost")).first()[0] == 2.0
    assert set(planning.cover_strata(rows, "intervention_id", ["cause_family"], 5)) and len(planning.cover_strata(rows, "intervention_id", ["cause_family"], 5)) == 3
    anchor = spark.createDataFrame([("a", 0), ("gone", 1), ("b", 2)], "id string, position int")
    kept = [r.id for r in planning.retain_and_replace(anchor, spark.createDataFrame([(x,) for x in "abcde"], "id string"), "id", 4).collect()]
    assert kept[:2] == ["a", "b"] and len(kept) == 4


def test_graph_edge_cases(spark):
    loop = spark.createDataFrame([("v", "a", "r", "a", 1), ("v", "b", "r", "c", 3), ("v", "b", "q", "c", 2)], "doc string, s string, r string, o string, mask long")
    top = views.top_nodes(views.neighbour_degrees(loop, ("f",)), ("f",), 5).collect()
    assert {(r.family, r.node): r.degree for r in top} == {("base", "a"): 0, ("base", "b"): 1, ("base", "c"): 1, ("f", "b"): 1, ("f", "c"): 1}
    with pytest.raises(ValueError, match="negative"):
        views.top_nodes(loop, ("f",), -1)
    assert [(r.a, r.b, r.mask) for r in views.short_connectivity(loop).collect()] == [("b", "c", 3)]
    docs = spark.createDataFrame([("v",), ("w",)], "doc string")
    assert {(r.family, r.doc): r.jaccard for r in views.jaccard(docs, loop, ("f",)).collect()} == {("f", "v"): 1 / 3, ("f", "w"): 1.0}
    assert {r.doc: r.preserved for r in views.path_preservation(docs, loop, ("f",)).collect()} == {"v": 1.0, "w": 1.0}


def test_distances_end_by_themselves(spark):
    chain = [("v", f"n{i:02d}", "r", f"n{i + 1:02d}", 1 if i == 5 else 3) for i in range(9)] + [("v", "n09", "r", "n00", 3), ("v", "n00", "r", "n07", 2)]
    elements = spark.createDataFrame(chain, "doc string, s string, r string, o string, mask long")
    sources = spark.createDataFrame([("v", "n00")], "doc string, source string")
    got = {(r.node, r.hops): r.mask for r in views.distances(elements, sources).collect() if r.hops}
    assert got[("n05", 5)] == 3 and got[("n06", 6)] == 1 and got[("n07", 7)] == 1 and got[("n07", 1)] == 2 and got[("n09", 9)] == 1 and got[("n09", 3)] == 2 and len(got) == 12


def test_gold_recall_without_gold(spark):
    docs = spark.createDataFrame([("v",), ("w",)], "doc string")
    elements = spark.createDataFrame([("v", "a", "r", "b", 3), ("v", "a", "r", "c", 1)], "doc string, s string, r string, o string, mask long")
    gold = spark.createDataFrame([("v", "a", "r", "b"), ("v", "a", "r", "c")], "doc string, s string, r string, o string")
    got = {r.doc: (r.base_recall, r.recall, r.difference) for r in views.gold_recall(docs, elements, gold, ("f",), ["s", "r", "o"]).collect()}
    assert got == {"v": (1.0, 0.5, 0.5), "w": (0.0, 0.0, 0.0)}


def test_components(spark):
    chain = [("v", f"n{i:02d}", "r", f"n{i + 1:02d}") for i in range(20)] + [("v", "x", "r", "y"), ("v", "l", "r", "l"), ("w", "a", "r", "b")]
    got = graph_queries.component_counts(spark.createDataFrame(chain, "view string, s string, r string, o string"), ["view"]).collect()
    assert {r.view: r.n_components for r in got} == {"v": 3, "w": 1}


def test_contract_rules():
    with pytest.raises(ValueError, match="already"):
        contracts.default_registry().register(contracts.CONTRACTS[0])


def test_resolution(spark):
    runs = spark.createDataFrame([("r1", "old"), ("r2", "old"), ("r3", None)], "run_id string, cf_event_id string")
    witness = spark.createDataFrame([("r1", "ev::9::x1", 2), ("r1", "ev::1::x0", 1)], "run_id string, edge_id string, ordinal int")
    exact = spark.createDataFrame([("r1", "e"), ("r2", "e")], "run_id string, event_id string")
    near = spark.createDataFrame([("r3", "n")], "run_id string, event_id string")
    got = {r.run_id: r.resolved_event_id for r in lineage.resolved_event(runs, witness, exact, near, "run_id").collect()}
    assert got == {"r1": "ev::1", "r2": "e", "r3": "n"}


def test_bootstrap_weights_have_unit_mean(spark):
    w = spark.range(20_000).select(statistics.multiplicity(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.06


def test_sentences_and_words(spark):
    plain = "Dr. Smith et al. Found it. (See Fig. 2.) It was 3 mg/kg vs. None!  Then U.S. Law ended? yes"
    row = spark.createDataFrame([(plain, ["It", "'s", "(", "ok", ")", ",", "``", "x"], ["(", "a", "$", "5", "]"])], "t string, w array<string>, v array<string>").select(
        text.sentences(F.col("t")).alias("s"), text.detokenise(F.col("w")).alias("w"), text.detokenise(F.col("v")).alias("v"), text.tokens_with_places(F.col("t")).alias("k"), text.sentences(F.lit("  ")).alias("none"),
        text.token_span(text.tokens_with_places(F.col("t")), F.lit(4), F.lit(9)).alias("span"),
    ).first()
    assert [x.text for x in row.s] == ["Dr. Smith et al. Found it.", "(See Fig. 2.) It was 3 mg/kg vs. None!", "Then U.S. Law ended? yes"]
    assert all(plain[x.start : x.stop] == x.text for x in row.s) and row.none == []
    assert (row.w, row.v) == ("It's ( ok), `` x", "(a $ 5]")
    assert [x.token for x in row.k][:6] == ["Dr", ".", "Smith", "et", "al", "."] and all(plain[x.start : x.stop] == x.token for x in row.k) and "mg/kg" in [x.token for x in row.k]
    assert tuple(row.span) == (2, 3)


def test_schema_variants(spark):
    relations = [("P17", "country", "d1"), ("P131", "located in", "d2"), ("P50", "author", "d3"), ("OTHER", "other", "")]
    frame = spark.createDataFrame([(relations,)], "r array<struct<id:string,label:string,description:string>>")

    def ids(kind, **options):
        return [tuple(x) for x in frame.select(extraction.schema_variant(F.col("r"), kind, **options).alias("r")).first().r]

    assert [x[0] for x in ids("ambiguous", dropped=("P17", "P50", "OTHER"))] == ["P131", "OTHER", "related_to"]
    assert [x[0] for x in ids("coarse", coarse={"P17": "place", "P131": "place"})] == ["place", "P50", "OTHER"] and ids("coarse", coarse={"P17": "place", "P131": "place"})[0][2] == "Coarse bucket of P17, P131"
    assert [x[0] for x in ids("drop", dropped=("P17",))] == ["P131", "P50", "OTHER"] and [x[0] for x in ids("reorder")] == ["OTHER", "P50", "P131", "P17"]
    assert ids("rename", renames={"P17": "in"})[0] == ("in", "country", "d1") and {x[2] for x in ids("desc_removed")} == {""}


EXAMPLE = {"title": "A b", "sents": [["x", "."]], "vertexSet": [[{"name": "", "type": "T", "sent_id": 0, "pos": [0, 1]}], [{"name": "x", "type": "T", "sent_id": 0, "pos": [0, 1]}]], "labels": [{"h": 0, "t": 1, "r": "P1", "evidence": [0]}, {"h": 0, "t": 0, "r": "P2"}]}


def test_docred_shapes(spark, tmp_path):
    columns = EXAMPLE | {"labels": {"head": [0, 0], "tail": [1, 0], "relation_id": ["P1", "P2"], "relation_text": ["P1", "P2"], "evidence": [[0], []]}}
    (tmp_path / "array.json").write_text("\n " + json.dumps([EXAMPLE] * 3, indent=1))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(x) for x in (EXAMPLE, columns, EXAMPLE | {"title": "last"})))
    array, lines = (corpora.read_docred(spark, str(tmp_path / n)) for n in ("array.json", "lines.jsonl"))
    assert array.count() == 3 and [r.title for r in lines.orderBy("idx").collect()] == ["A b", "A b", "last"]
    assert {r.document_id for r in lines.collect()} == {"docred-dev-000000-A_b", "docred-dev-000001-A_b", "docred-dev-000002-last"}
    assert lines.select("labels").distinct().count() == 1 and lines.first().labels.evidence == [[0], []]
    assert corpora.read_docred(spark, str(tmp_path / "lines.jsonl"), limit=2).count() == 2
    corpora.write_lines(lines.drop("idx", "document_id"), str(tmp_path / "mirror"))
    assert corpora.read_docred(spark, str(tmp_path / "mirror")).count() == 3
    lines.select("title", "sents", "vertexSet", "labels").write.parquet(str(tmp_path / "branch/default/validation/part.parquet"))
    assert corpora.read_docred(spark, str(tmp_path / "branch/default/validation/part.parquet")).first().labels.head == [0, 0]
    # The cluster without a name is no entity, and labels count the named ones.
    assert [(r.gold_edge_id[-2:], r.head_name, r.head_entity_id, r.tail_name) for r in corpora.gold_edges(lines.where("idx = 0")).collect()] == [("g0", "x", "docred-dev-000000-A_b::e1", "#1"), ("g1", "x", "docred-dev-000000-A_b::e1", "x")]


def test_scierc_and_cdr(spark, tmp_path):
    doc = {"doc_key": "k", "sentences": [["We", "use", "deep", "nets", "."], ["They", "win", "."]], "ner": [[[2, 3, "Method"]], [[5, 5, "Generic"], [5, 5, "Generic"]]], "clusters": [[[2, 3], [5, 5]]], "relations": [[[2, 3, 0, 0, "USED-FOR"]], [[5, 5, 6, 6, "X"]]]}
    alone = doc | {"doc_key": None, "clusters": [], "relations": [[[2, 3, 5, 5, "USED-FOR"], [2, 3, 2, 3, "SELF"]], []]}
    (tmp_path / "s.json").write_text(json.dumps(doc) + "\n" + json.dumps(alone) + "\n")
    one, two = corpora.read_scierc(spark, str(tmp_path / "s.json")).orderBy("idx").collect()
    assert [[(m.name, m.type, m.sent_id, m.pos) for m in c] for c in one.vertexSet] == [[("deep nets", "Method", 0, [2, 4]), ("They", "Method", 1, [0, 1])]] and one.labels.head == []
    assert two.title == "scierc_1" and [c[0].type for c in two.vertexSet] == ["Method", "Generic"] and (two.labels.head, two.labels.tail, two.labels.evidence) == ([0], [1], [[0]])
    block = "7|t|Aspirin harms.\n7|a|It causes ulcer pain. Aspirin again.\n7\t0\t7\tAspirin\tChemical\tD1\n7\t25\t35\tulcer pain\tDisease\tD2|D3\n7\t37\t44\tAspirin\tChemical\tD1\n7\t8\t13\tharms\tDisease\t-1\n7\tCID\tD1\tD2\n7\tCID\tD1\tD9\n"
    (tmp_path / "c.txt").write_text(block + "\n")
    cdr = corpora.read_cdr(spark, str(tmp_path / "c.txt")).first()
    assert cdr.title == "7" and cdr.sents == [["Aspirin", "harms", "."], ["It", "causes", "ulcer", "pain", "."], ["Aspirin", "again", "."]]
    assert [[(m.name, m.sent_id, m.pos) for m in c] for c in cdr.vertexSet] == [[("Aspirin", 0, [0, 1]), ("Aspirin", 2, [0, 1])], [("ulcer pain", 1, [2, 4])], [("ulcer pain", 1, [2, 4])]]
    assert (cdr.labels.head, cdr.labels.tail, cdr.labels.evidence) == ([0], [1], [[0, 1, 2]])


def test_database_guard(spark, tmp_path):
    path = str(tmp_path / "g.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        con.execute("INSERT INTO t VALUES ('a', 1), ('b', 2)")
    con.close()
    spark.dataSource.register(corpora.SqliteSource)
    with corpora.unchanged(path):
        assert sorted(tuple(r) for r in spark.read.format("sqlite").option("path", path).option("table", "t").load().collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(RuntimeError, match="changed"), corpora.unchanged(path), sqlite3.connect(path) as con:
        con.execute("INSERT INTO t VALUES ('c', 3)")
    con.close()
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("INSERT INTO t VALUES ('d', 4)")
    con.commit()
    with pytest.raises(RuntimeError, match="log"), corpora.unchanged(path):
        pass
    con.close()


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 0, "old"), ("z", 0, "old")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 1, "first"), ("a", 2, "last"), ("b", 1, "new")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in lineage.upsert(old, new, ["k"], ["n"]).collect()) == [("a", "last"), ("b", "new"), ("z", "old")]


def test_prompt_variants(spark):
    from driftloom.operators import interventions

    clauses = [("C0_role", "old"), ("C1_evidence_only", "a"), ("C2_infer_implicit", "b")]
    frame = spark.createDataFrame([(clauses,)], "c array<struct<id:string,text:string>>")
    ids = lambda *a, **k: [tuple(x) for x in frame.select(interventions.prompt_variant(F.col("c"), *a, **k).alias("v")).first().v]
    assert [x for x, _ in ids("drop", ("C1_evidence_only", "C9"))] == ["C0_role", "C2_infer_implicit"]
    assert ids("add", "C7", text="new")[-1] == ("C7", "new") and len(ids("add", "C7", text="new")) == 4
    assert ids("role", "novice")[0] == ("C0_role", interventions.ROLES["novice"]) and len(ids("role", "novice")) == 3
    assert ids("tone", "nothing like it")[-1] == ("C9_tone", interventions.TONES["terse"])


def test_levels_that_mask_alike_are_an_error(spark):
    frame = spark.createDataFrame([("d", "a b c")], "doc string, text string")
    with pytest.raises(Exception, match="equally many"):
        extraction.mask_nested(frame, (0.1, 0.2), strict=True).collect()
    assert [r.changed for r in extraction.mask_nested(frame, (0.1, 0.5), strict=True).orderBy("level").collect()] == [1, 2]


def test_prompt_parts(spark):
    from driftloom.functions import prompts

    frame = spark.createDataFrame([([("P1", "in", " where "), ("P2", "of", None)], [("Ann", None, "e1"), ("Bob", "PER", "e2")])], "r array<struct<id:string,label:string,description:string>>, e array<struct<canonical_name:string,entity_type:string,entity_id:string>>")
    row = frame.select(prompts.schema_text(F.lit("S"), F.lit(None).cast("string"), F.col("r")).alias("s"), prompts.entities_text(F.col("e")).alias("e"), prompts.cache_key(F.lit("m"), F.lit(0.5), F.lit(None), F.lit("p")).alias("k")).first()
    assert row.s == "Schema id: S\nDescription: \nRelations:\n  - P1 (in): where\n  - P2 (of): " and row.e == "- Ann (type=ENT, id=e1)\n- Bob (type=PER, id=e2)"
    import hashlib

    assert row.k == hashlib.sha256(b"m=m|t=0.5|s=None\np").hexdigest()


def test_completed_keys_and_empty_lineage(spark):
    records = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "failed"), ("b", 1, "failed"), ("b", 2, "ok")], "k string, n int, status string")
    assert [r.k for r in lineage.completed_keys(records, ["k"], ["n"]).collect()] == ["b"]
    none = spark.createDataFrame([], "run_id string, base_event_id string, cf_event_id string")
    docs, elements, families, index = views.indexed(none, spark.createDataFrame([], "event_id string, s string, r string, o string"))
    assert families == () and docs.count() == elements.count() == index.count() == 0


def test_kept_tables_are_made_again_when_inputs_change_or_they_are_gone(spark, tmp_path):
    import shutil

    from driftloom.sources import store

    path, made = str(tmp_path / "in.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert store.kept(spark, "k", [path], make).count() == store.kept(spark, "k", [path], make).count() == 3 and len(made) == 1
    shutil.rmtree(store.kept(spark, "k", [path], make).written_at)
    assert store.kept(spark, "k", [path], make).count() == 3 and len(made) == 2
    spark.range(5).write.mode("append").parquet(path)
    assert store.kept(spark, "k", [path], make).count() == 8 and len(made) == 3


def test_versioned_tables(spark, tmp_path):
    table = corpora.Versioned(spark, str(tmp_path / "outcomes"))
    assert table.latest() == 0
    assert table.put(spark.createDataFrame([("o1", 1, "EXACT_SAME"), ("o2", 1, "DISAPPEARED")], "outcome_id string, n int, kind string"), ["outcome_id"]) == 1
    (tmp_path / "outcomes" / "v7").mkdir()  # a version that was never completed
    assert table.put(spark.createDataFrame([("o2", 1, "TYPE_FLIP"), ("o2", 2, "OBJECT_FLIP"), ("o3", 1, "AMBIGUOUS")], "outcome_id string, n int, kind string"), ["outcome_id"], ["n"]) == 2
    assert sorted((r.outcome_id, r.kind) for r in table.read().collect()) == [("o1", "EXACT_SAME"), ("o2", "OBJECT_FLIP"), ("o3", "AMBIGUOUS")]


def test_registered_artifacts_and_reports(spark, tmp_path):
    import hashlib

    corpora.write_report(spark.createDataFrame([("K2", 0.25, None), ("K1", 0.5, 3)], "contract string, rate double, n int"), str(tmp_path / "r"), "Contracts")
    assert (tmp_path / "r.md").read_text().splitlines()[2:] == ["| contract | rate | n |", "| --- | --- | --- |", "| K1 | 0.500 | 3 |", "| K2 | 0.250 |  |"]
    digest = hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest()
    assert [x.contract for x in corpora.read_registered(spark, str(tmp_path / "r.json"), digest).first().rows] == ["K1", "K2"]
    with pytest.raises(ValueError, match="registered"):
        corpora.read_registered(spark, str(tmp_path / "r.json"), "0" * 64)
