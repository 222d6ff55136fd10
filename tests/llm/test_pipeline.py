import random

import numpy as np
import test_simhash
import test_superkmer
import test_wumanber

import corpus_pipeline
from cityweave.llm import packing, superkmer


def corpus():
    r = random.Random(8)
    words = ["the", "stone", "river", "Tree", "of", "éa", "hill", "cloud", "grass", "bird", "sand", "moon"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    shared, test = text(30), text(14)
    good = [(k, text(r.randint(5, 80))) for k in range(120)]
    good += [(200 + k, text(20) + " " + shared + " " + text(20)) for k in range(6)]
    good += [(300 + k, good[k][1]) for k in range(10)]
    good += [(400 + k, text(15) + "\n" + test + " " + text(10)) for k in range(4)]
    junk = [(500 + k, " ".join(r.choice(words).upper() + "###" for _ in range(40))) for k in range(15)]
    return good, junk, [(1, test), (2, "unrelated words that never occur in any of the texts at all")]


def test_stages_equal_brute_force(spark, tmp_path):
    good, junk, items = corpus()
    folder = f"file://{tmp_path}"
    rows = [(i, t, "en", "s", len(t)) for i, t in good + junk]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = {i: t for i, t in good + junk}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        before = sorted(now.items())
        if name == "quality_classifier":
            now = dict(good)
        elif name == "near_dedup":
            now = {i: t for (i, t), (j, _, c) in zip(before, sorted(test_simhash.brute_components(before))) if i == c and i == j}
        elif name == "substring_dedup":
            gone = {i: n for i, _, n, _ in test_superkmer.brute(before, superkmer.WINDOW)}
            assert any(gone.values())
            got = {r.doc_id: r for r in out.collect()}
            assert all(got[i].text == t for i, t in before if not gone[i])
            assert all(len(t.split()) - len(got[i].text.split()) == gone[i] for i, t in before)
            assert all(r.n_chars == len(r.text) for r in got.values())
            now = {i: r.text for i, r in got.items()}
        elif name == "decontamination":
            now = {i: now[i] for i, _, hit, *_ in test_wumanber.brute(before, items) if not hit}
        else:
            memo = packing.Memo(packing.default_tokenizer())
            want = {i: len(memo.ids(t)) // 4 + 1 for i, t in before}
            total: dict[int, int] = {}
            for r in out.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == want
            continue
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(now.items()), name
        assert len(now) < len(before) or name == "substring_dedup"
    run = corpus_pipeline.run(spark, folder)
    assert run.agg({"length": "sum"}).first()[0] == sum(want.values())
    assert np.isfinite(run.count())


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


CLASHING = ["_id", "_key", "_spans", "_i", "_k", "_n", "_row_key", "span_id", "span_key", "spans", "rank_id", "rank_key", "rank_number", "fence", "fence_lang", "judged", "loss", "node", "root", "body", "id", "key", "value", "row"]


def test_each_stage_with_odd_rows(spark, tmp_path):
    """Clashing names, null texts and ids, repeated rows, no n_chars: the stages keep columns and rows as they state."""
    good, junk, items = corpus()
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (None, good[0][1]), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = tuple(range(len(CLASHING)))
    rows = good + [(900, None), (901, ""), (None, good[1][1] + " stone"), (None, None), good[2], good[2], (2, "river of sand.")]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", *extra) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASHING))
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("quality_classifier", "near_dedup", "substring_dedup", "decontamination"):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns, name
        kept[name] = [tuple(r) for r in out.collect()]
        assert all(r[3:] == extra for r in kept[name]), name
    texts = lambda name: sorted(((r[0], r[1]) for r in kept[name]), key=str)
    assert texts("quality_classifier") == sorted(((i, t) for i, t in rows if t), key=str)
    assert len([x for x in texts("near_dedup") if x[0] in (900, 901)]) == 1
    assert sum(x == good[2] for x in texts("near_dedup")) <= 1
    assert sorted((str(i) for i, _ in texts("substring_dedup"))) == sorted(str(i) for i, _ in rows)
    hit = {i for i, _, n, *_ in test_wumanber.brute(rows, items) if n}
    assert texts("decontamination") == sorted(((i, t) for i, t in rows if i not in hit), key=str)
    packed = stages["best_fit_packing"](spark, docs, folder).where("piece = 0").groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in packed) == len(rows)
