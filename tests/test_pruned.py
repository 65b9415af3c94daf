"""Scored context against all pairs of questions and turns, those among them that only a vector finds."""

from quillmark.operators import retrieval
from quillmark.plans import model
from quillmark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_pruned_context_is_the_best_of_all_pairs(spark):
    turns = [(r.conv_id, r.turn) for r in model.table(spark, SF, "conversations").where("role = 'user'").collect()]
    asked = [r.query_id for r in model.questions(spark, SF).collect()]
    vec = {r.vec_id: [float(x) for x in r.embedding] for r in model.table(spark, SF, "embeddings").collect()}
    found = retrieval.bm25(model.questions(spark, SF), model.table(spark, SF, "conversations").where("role = 'user'"), ["conv_id", "turn"])
    bm25 = {(r.query_id, r.conv_id, r.turn): r.bm25 for r in found.collect()}
    got: dict = {}
    for r in QUERIES["pruned_context"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.conv_id, r.turn, r.score))
    alone = 0
    for q in asked:
        best = max((v for (k, *_), v in bm25.items() if k == q), default=0.0)
        rows = []
        for c, t in turns:
            emb = sum(a * b for a, b in zip(vec[q * 7 % len(vec)], vec[(c * 13 + t) % len(vec)], strict=True)) if t % 5 != 4 else None
            own = bm25.get((q, c, t))
            if own is None and (emb is None or emb <= 0):
                continue
            norm = (own or 0.0) / best if best >= 0.05 else 0.0
            rows.append((0.55 * max(0.0, emb) + 0.45 * norm if emb is not None else 0.45 * norm, c, t, own))
        rows.sort(key=lambda x: (-round(x[0], 6), x[1], x[2]))
        alone += sum(x[3] is None for x in rows[:8])
        assert [x[3] for x in sorted(got[q])] == [round(x[0], 6) for x in rows[:8]] or all(abs(a[3] - b[0]) < 2e-6 for a, b in zip(sorted(got[q]), rows[:8], strict=True))
    assert alone  # some of the best have no word in common with the question
