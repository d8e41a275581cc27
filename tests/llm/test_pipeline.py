import re

import corpus_pipeline
from barspark.llm.common import table
from tests.llm.test_packing import whole
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(t):
    return re.sub(r"[ \t-\r]", "", t or "")


def test_stages_are_brute_force(spark):
    docs = table(spark, SF, "documents")
    bench = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    wins = {tuple(w[i:i + 10]) for w in bench for i in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        ids = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            want = {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[plain(r.text)] = min(best.get(plain(r.text), (9, 9)), (-len(r.text or ""), r.doc_id))
            want = {d for _, d in best.values()}
        elif name == "near_dedup":
            want = set(brute_components([r.doc_id for r in before], [brute_fingerprint(r.text) for r in before]))
        elif name == "decontamination":
            want = {r.doc_id for r in before if not any(tuple(w[i:i + n]) in wins for w in [words(r.text)] for n in {len(x) for x in wins} for i in range(len(w) - n + 1))}
        else:
            whole(docs.collect(), {r.doc_id: r.text for r in before}, 1024)
            want = {r.doc_id for r in before}
        assert ids == want, name


def test_edge_cases(spark):
    good = "der und die schöne erung enheit der das keit ung"
    rows = [(1, good, "de", "x"), (1, good, "de", "x"), (None, good + " ung", None, "y"), (2, None, "de", None), (3, "", None, None), (4, "!! 12", None, "z"),
            (5, good.replace(" ", "  "), "de", "q"), (6, good, "de", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang_pred string")
    left = corpus_pipeline.language(spark, df, SF)
    assert left.columns == df.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in df.collect() if r.text and "u" in r.text)
    left = corpus_pipeline.exact(spark, df, SF)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 2, 4, 5] and left.columns == df.columns
    left = corpus_pipeline.near(spark, df.where("doc_id <= 1 or doc_id = 2"), SF)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert corpus_pipeline.clean(spark, df, SF).count() == len(rows)
    assert all(f(spark, df.limit(0), SF).count() == 0 for _, f in corpus_pipeline.STAGES)
