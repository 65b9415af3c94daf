"""Scalar functions, scanners and sources on small rows, CJK included."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import text as T
from quillmark.operators import consolidate, graph, maintain, memory
from quillmark.sources import readers, sinks


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.bm25_bag, "Ab 我 x 喜欢", ["ab", "x", "我", "喜", "欢", "我喜", "喜欢"]),
        (T.bm25_bag, None, []),
        (T.word_set, "B a B_1", ["b", "a", "b_1"]),
        (T.graph_tokens, " The 关 Graph of X ", ["关", "graph", "x"]),
        (T.schema_tokens, "12 ab abc 关系 the", ["abc", "关系"]),
        (T.delta_tokens, "Été 我们 x", ["été", "我们", "x"]),
        (T.smoke_tokens, "a_b 我们 the", ["b", "我们"]),
        (T.clauses, "Mr. A met B and C left; D.", ["Mr. A met B", "C left", "D"]),
        (T.capitalized, "New York met Bo", ["Bo", "New York"]),
    ],
)
def test_tokenizers(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.entity_key, " The  API's Core! ", "the-apis-core"),
        (T.relation_key, "Depends On", "depends_on"),
        (lambda c: T.excerpt(c, 10), "abcdefghijklm", "abcdefg..."),
        (T.is_question, "Where is it", True),
        (T.is_commitment, "We are GOING TO ship", True),
        (T.rough_token_count, "ab 我们", 3),
        (T.sentence_count, "One. Two!", 2),
        (lambda c: T.term_count(c, ("if", "so far")), "If so  far, iffy if", 3),
        (T.strip_fence, "```json\n{}\n```", "{}"),
    ],
)
def test_measures(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_quotes(spark):
    assert one(spark, T.quote_covered(F.col("q"), F.col("t")), q="alpha beta gamma delta", t="gamma delta alpha beta epsilon")
    assert not one(spark, T.quote_covered(F.col("q"), F.col("t")), q="alpha beta gamma", t="alpha beta gamma")


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"])], "x array<string>, y array<string>")
    got = df.select(A.union(F.col("x"), F.col("y"), most=2), A.overlap_ratio(F.col("x"), F.col("y")), A.jaccard(F.col("x"), F.col("y"))).first()
    assert tuple(got) == (["a", "b"], 0.5, pytest.approx(1 / 3))


def test_sentences():
    text = 'Dr. Wu paid 3.5 euros. "Fine!" she said. 好的。他走了！ J. Doe left'
    spans = [text[a:b] for a, b in memory.sentence_spans(text)]
    assert spans == ["Dr. Wu paid 3.5 euros.", '"Fine!"', "she said.", "好的。", "他走了！", "J. Doe left"]
    assert memory.sentence_spans("") == []


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "a" * 700 + "\n\n" + "b" * 600 + "\n \nc")], "id long, text string")
    assert [(r.unit_no, r.n_chars) for r in memory.paragraph_units(df, "id").orderBy("unit_no").collect()] == [("P0001", 700), ("P0002", 603)]


def test_relation_candidates(spark):
    texts = {
        1: "Ana uses Redis. The API depends on Postgres because of history; Bo met Cy and Dee likes tea after lunch.",
        2: None,
        3: "I went to Old Chapel and she thinks him",
        4: "Read the green book. They encourage Gina",
        5: "We learned from Master Lee; Kim criticized our roadmap in public",
        6: "You said hello there, but I want a pony",
        7: "It looks bright when visited",
    }
    df = spark.createDataFrame([(k, "user", t) for k, t in texts.items()], "id long, who string, text string")
    got = [(r.id, r.kind, r.type, r.source_hint, r.target_hint) for r in consolidate.relation_candidates(df, ["id"], "who").orderBy("id", "clause_no").collect()]
    assert got == [
        (1, "relation", "uses", "user", "Redis"),
        (1, "relation", "depends_on", "user", "Postgres"),
        (3, "relation", "visited", "user", "Old Chapel"),
        (4, "relation", "read", "user", "green book"),
        (4, "relation", "encourages", "user", "Gina"),
        (5, "relation", "learns_from", "user", "Master Lee"),
        (5, "relation", "criticizes", "user", "roadmap"),
        (6, "claim", "interaction_hypothesis", "user", "hello there"),
        (6, "claim", "subject_relation_to_node", "user", "pony"),
        (7, "claim", "node_state_from_subject_perspective", "user", "bright"),
    ]


def test_relations_are_sought_in_all_conversations(spark):
    from quillmark.plans import model
    from quillmark.queries import QUERIES

    ev = model.evidence(spark, "/root/testdata/sf0.001").where("text RLIKE '(?i)\\\\b(is|are|was|were|said) +[a-z]{5,} '")
    got = QUERIES["regex_relations"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.join(model.evidence(spark, "/root/testdata/sf0.001"), "evidence_ref", "left_anti").count() == 0
    assert ev.join(got, "evidence_ref", "left_anti").count() <= 0.1 * ev.count()


def test_components_and_paths(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdxy"], "node_id string")
    edges = spark.createDataFrame([("1", "a", "b", 1), ("2", "b", "c", 1), ("3", "a", "d", 1), ("4", "d", "c", 1), ("5", "x", "x", 1)], "edge_id string, source string, target string, evidence_count long")
    assert {r.node_id: r.component for r in graph.weak_components(nodes, edges).collect()} == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "y"}
    seeds = nodes.where("node_id IN ('a', 'c')")
    assert [r.path for r in graph.shortest_paths(edges, seeds).collect()] == [["a", "b", "c"]]
    ranks = {r.node_id: r.rank for r in graph.pagerank(nodes, edges, rounds=50, tol=1e-9).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] == max(ranks[n] for n in "abcdy")


def test_maintenance(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    ok, bad = maintain.append_batch(base, spark.createDataFrame([(2, "z"), (3, "a"), (4, "b"), (4, "c")], "id long, v string"), "id")
    assert [r.id for r in ok.collect()] == [3] and sorted((r.id, r.reject_reason) for r in bad.collect()) == [(2, "id_already_registered"), (4, "id_repeated_in_batch"), (4, "id_repeated_in_batch")]


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(p), "a long").count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    p.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(p), "a long").collect()
    df = spark.createDataFrame([(1, "x")], "id long, v string")
    sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(FileExistsError):
        sinks.write_table(df, str(tmp_path / "t"))
    sinks.publish(spark, df, str(tmp_path / "cur"), str(tmp_path / "hist"))
    sinks.publish(spark, df.union(df), str(tmp_path / "cur"), str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "cur")).count() == 2 and spark.read.parquet(str(tmp_path / "hist" / "v000000")).count() == 1
    ents, rels = readers.annotations(spark.createDataFrame([("d", "T1\tPER 0 3\tAna"), ("d", "T2\tORG 5 7;9 11\tx"), ("d", "R1\tuses Arg1:T1 Arg2:T2")], "doc string, value string"))
    assert [tuple(r) for r in ents.collect()] == [("d", "T1", "PER", 0, 3, "Ana")] and rels.first().arg2 == "T2"
    parsed = readers.payloads(spark.createDataFrame([('```json\n{"n": 1}\n```',), ("nope",), (None,)], "output string"), "n long")
    assert [r.payload_status for r in parsed.collect()] == ["ok", "schema_validation_failed", "empty_output"]
