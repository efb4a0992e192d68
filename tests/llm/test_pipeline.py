"""The pipeline's stages, each held against what it should do with its own input."""

import random
import re

import corpus_pipeline
from catalux.llm import minhash, quality
from catalux.llm.common import DOC_COLUMNS

WORDS = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def tables(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ba", "te", "no", "ri", "lu", "sé"]) for _ in range(4))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    clean = [prose(8) for _ in range(40)]
    items = [" ".join(word() for _ in range(20)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, " ".join(w + "$%#"[k % 3] * 3 for k, w in enumerate(prose(8).split()))) for i in range(10)]
    near = clean[5].split(" ")
    near[3], near[40] = "ersatz", "andere"
    rows += [(200, clean[4]), (201, " ".join(near)), (202, clean[6] + "\n" + items[1] + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i, _ in rows if i < 40 or 100 <= i < 110], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    names, stages = zip(*corpus_pipeline.STAGES)
    kept = stages[0](spark, docs, str(tmp_path)).cache()
    want = {r.doc_id for r in quality.judge(docs, model).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want and tuple(kept.columns) == DOC_COLUMNS
    assert not any(100 <= i < 110 for i in want) and len([i for i in want if i < 40]) >= 35
    lines = stages[1](spark, kept, str(tmp_path))
    seen, expect = set(), {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        out = []
        for x in r.text.split("\n"):
            if x not in seen:
                out.append(x)
            seen.add(x)
        if "".join(out).strip():
            expect[r.doc_id] = "\n".join(out)
    assert {r.doc_id: r.text for r in lines.collect()} == expect
    # near duplicates and decontamination on the documents as they came
    single = stages[2](spark, docs, str(tmp_path))
    by = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    left = {r.doc_id for r in single.collect()}
    assert left == {i for i, c in by.items() if i == c} and 200 not in left and 4 in left and tuple(single.columns) == DOC_COLUMNS
    leak = {r.doc_id for r in docs.collect() if any(" ".join(WORDS(t)[k : k + 10]) in " ".join(WORDS(r.text)) for t in items for k in range(11))}
    rest = stages[3](spark, docs, str(tmp_path))
    assert leak == {202} and {r.doc_id for r in rest.collect()} == {r.doc_id for r in docs.collect()} - leak
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert names[-1] == "packing" and pieces and {p.doc_id for p in pieces} <= want - {202}
