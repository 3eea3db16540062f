"""corpus_pipeline.run on a small folder against its stages by brute force, and its resumption."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import quality
from tallyfold.llm.common import exists, shared_dir
from tests.llm.test_llm import low, naive_hits, shingle_set, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = np.random.default_rng(8)
    leak = words(40, 500)
    rows = [(1, None), (2, ""), (3, "  "), (None, words(50, 1)), (None, words(50, 1).upper())]
    rows += [(10 + i, words(int(r.integers(1, 400)), 10 + i)) for i in range(60)]
    rows += [(100 + i, rows[10 + i][1]) for i in range(20)] + [(10, rows[5][1])]  # copies, and a row twice
    rows += [(200 + i, rows[30 + i][1] + " end.") for i in range(10)]  # near copies
    long = words(6000, 900).split()
    rows += [(300, " ".join(long[:3000] + leak.split()[5:18] + long[3000:])), (301, leak), (302, words(30, 901) + " " + leak + "."), (303, " ".join(leak.split()[:12]))]
    rows += [(400 + i, "!!! $$$ ||| ### <<>> " * int(r.integers(3, 60)) + str(i)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, leak), (8, None), (9, "end")], "item_id long, text string").filter("item_id <> 9").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def brute(spark, d):
    """doc_id and text of what reaches packing."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = [(r.doc_id, r.text) for r in quality.score(docs.drop("score"), model).filter(F.col("score") >= 0.3).collect()]
    best = {}
    for i, t in good:
        k = low(t)
        if k not in best or (i if i is not None else -1) > (best[k][0] if best[k][0] is not None else -1):
            best[k] = (i, t)
    kept = list(best.values())
    sets = [shingle_set(t) for _, t in kept]
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(kept)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if (sets[x] and sets[y] and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both)) or not (sets[x] or sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for x, row in enumerate(kept):
        groups.setdefault(find(x), []).append(row)
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    return [(i, t) for i, t in first if not naive_hits(t, items)[1]]


def test_run(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = brute(spark, folder)
    ids = {i for i, _ in want}
    assert 303 in ids and not ids & {300, 301, 302} and len(want) > 50 and not any(i and i >= 400 for i in ids)
    pieces = corpus_pipeline.run(spark, folder, "first").collect()
    sizes = {}
    for p in pieces:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= 1024
    lists = {}
    for i, t in want:
        lists.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert sizes == {i: sum(map(len, x)) for i, x in lists.items()}
    for p in pieces:
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in lists[p.doc_id])
    # Only the result is left; a run of the same id takes it, and one that lost its last stage does only that.
    at = f"{shared_dir(spark)}/pipeline-first"
    assert [exists(spark, f"{at}/{k}") for k in range(5)] == [False] * 4 + [True]
    stages, ran = list(corpus_pipeline.STAGES), []
    try:
        corpus_pipeline.STAGES[:] = [(n, lambda *a, n=n, f=f: ran.append(n) or f(*a)) for n, f in stages]
        assert corpus_pipeline.run(spark, folder, "first").count() == len(pieces) and not ran
        corpus_pipeline.STAGES[4] = ("packing", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            corpus_pipeline.run(spark, folder, "second")
        assert len(ran) == 4
        corpus_pipeline.STAGES[4] = ("packing", lambda *a: ran.append("packing") or stages[4][1](*a))
        assert sorted(map(str, corpus_pipeline.run(spark, folder, "second").drop("sequence_id", "offset").collect())) == sorted(str(p) for p in spark.read.parquet(f"{at}/4").drop("sequence_id", "offset").collect())
        assert len(ran) == 5 and ran[4] == "packing"
    finally:
        corpus_pipeline.STAGES[:] = stages


def test_run_empty(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
