from collections import Counter

import test_mixing as mixing
import test_resampling as resampling
import test_sharding as sharding
import test_similar_sets as similar_sets
import test_tiling as tiling

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]  # doc_id, text, lang, source, n_chars
    drawn = resampling.plain([r[:2] for r in rows], labels)
    wanted = [[r for r, w in zip(rows, drawn, strict=True) if w[2]]]
    kept = set(similar_sets.plain_kept([r[:2] for r in wanted[-1]]))  # the stage's own rule: five words, Jaccard 0.8
    wanted.append([r for r in wanted[-1] if r[0] in kept])
    wanted.append([r for r in wanted[-1] if not tiling.plain_leaks([r[:2]], items)])
    taken = {d: int(t / n + 0.5) if n else 0 for d, n, _, _, t in mixing.plain([(r[0], r[1], r[3]) for r in wanted[-1]])}
    wanted.append([r for r in wanted[-1] for _ in range(taken[r[0]])])
    assert all(len(a) > len(b) > 50 for a, b in zip([rows, *wanted[:2]], wanted[:3], strict=True))
    now = docs
    for (_, stage), want in zip(P.STAGES[:4], wanted, strict=True):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        assert Counter(map(tuple, now.collect())) == Counter(want)
    got = P.run(spark, SF)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert Counter(((r.doc_id, r.text), r.shard) for r in got.collect()) == sharding.plain([r[:2] for r in wanted[3]], 8, 128)
    assert P.ORACLE_SQL is None


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns of any names come through every stage."""
    names = ["_size", "_cell", "_key", "_mark", "row", "shard_of", "set", "n", "target", "taken", "log_weight", "coverage"]
    sample = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    text = sample[3][1]
    odd = [(None, None, None, None, None), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (900, "", "en", None, 0), (901, " \n", None, "s", 2),
           (902, text, "en", "s", 1), (902, text, "en", "s", 1), (903, text + " and more", "en", "", 1), (904, "word " * 60000, "en", "s", None), (905, None, "x", "y", -1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(*r, *[f"{n}-{i}" for n in names]) for i, r in enumerate([*sample, *odd])]
    now = spark.createDataFrame(rows, schema)
    before = {tuple(r) for r in rows}
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, now, SF)
        assert out.columns == [*now.columns, "shard", "slot"] if k == 4 else out.columns == now.columns
        got = [tuple(r) for r in out.collect()]
        assert got and {r[: len(now.columns)] for r in got} <= before  # rows as they were
        if k == 1:
            assert len([r for r in got if r[0] in (902, 3)]) <= 2 and len({r[0] for r in got if r[0] is not None}) == len([r for r in got if r[0] is not None])
        before = {r[: len(now.columns)] for r in got}
        now = spark.createDataFrame([r[: len(now.columns)] for r in got], schema)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 0
