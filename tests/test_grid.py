import zlib

from pyspark.sql import functions as F

from blobloom.plans import grid, registry


def test_registered_grid_is_whole(spark, monkeypatch):
    # Laid out, not measured: all sizes of the registered query, each with all kinds.
    monkeypatch.setattr(grid, "measure", lambda content, vocabularies: content)
    monkeypatch.setattr(registry, "_vocabularies", lambda spark, sf_dir: {})
    rows = registry.bench_grid(spark, "").select("kind", "size_kb").collect()
    assert {r.size_kb for r in rows} == {2**k for k in range(1, 12)} and len(set(rows)) == len(rows) == 11 * len(grid.KINDS)
    assert {"chinese", "russian", "japanese", "cpp"} <= {r.kind for r in rows}


def test_lines_fill_every_size(spark):
    assert grid.generate(spark, (2, 16)).where(F.octet_length("content") != F.col("size_kb") * 1024).count() == 0


def test_sizes_filters_and_figures(spark):
    df = spark.createDataFrame([("Code", 2, 1000, 500, 600), ("Data", 16, 2048, 9000, 9000)], "category string, size_kb int, original long, packed long, deflate_only long")
    assert spark.range(1).select(grid.parsed_sizes(F.lit("64, 2,16"))).first()[0] == [2, 16, 64]
    d = grid.derived(df)
    assert [r.category for r in grid.filtered(d, "Code").collect()] == ["Code"] and [r.category for r in grid.filtered(d, size_kb=16).collect()] == ["Data"] and grid.filtered(d).count() == 2
    got = {r.category: r for r in grid.formatted(d, "category").collect()}
    assert (got["Code"].original_kb, got["Code"].packed_kb, got["Code"].positive, got["Code"].style) == ("1.0", "0.5", True, "code") and got["Data"].gain_pct == "1.3"


def test_measures_are_real(spark):
    tokens = {"text": (*(bytes([i]) for i in range(256)), b" the", b"ing ")}
    made = grid.measure(grid.generate(spark, (2,)).where("kind in ('english', 'json')"), tokens).collect()
    assert {r.kind for r in made} == {"english", "json"}
    content = {r.kind: bytes(r.content) for r in grid.generate(spark, (2,)).collect()}
    for r in made:
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        assert r.deflate_only == len(z.compress(content[r.kind]) + z.flush()) and r.original == 2048
        assert r.packed - grid.CONTAINER <= min(r.deflate_only, r.original)
    total = {(r.category, r.size_kb): (r.tests, r.wins) for r in grid.summary(grid.measure(grid.generate(spark, (2,)).where("kind in ('english', 'json')"), tokens)).collect()}
    assert total[None, None] == (2, 2) and total[None, 2] == (2, 2) and total["prose", None] == (1, 1)


def test_figures_are_rounded_as_c_prints_them(spark):
    # Ties of exact binary values go to the even digit; what only looks like a tie goes by its binary value.
    xs = [31.25, 81.25, 6.25, 0.25, 0.75, -31.25, 0.05, 0.15, 0.35, 1.45, 12.35, -0.04, 0.0, 99.95, 1234.5, -7.05, 2.0, 31.3, *(k / 1024 for k in range(0, 3000, 64)), *(k / 100 for k in range(5, 4000, 10))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, x double").select("i", grid.tenths(F.col("x")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == [*("%.1f" % x for x in xs), None]
