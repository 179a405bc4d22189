"""The benchmark grid: generated content of several kinds and sizes, measured by every codec, and its roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import choose, codecs

#: (kind, category, templates); a template's {n} is the running number, {w} a word.
KINDS: list[tuple[str, str, list[str]]] = [
    ("english", "prose", ["The {w} went home after the long day was over. ", "It was {n} years ago that this {w} began to grow. "]),
    ("german", "prose", ["Das {w} ist nicht für die Kinder und der Rest. ", "Ein Jahr mit {n} Tagen ist auf {w} kaum lang. "]),
    ("french", "prose", ["Le {w} est dans la maison avec une lampe. ", "Pour les {n} jours du {w}, on reste ici. "]),
    ("spanish", "prose", ["El {w} de la casa es para los hijos. ", "En {n} meses una {w} cambia por completo. "]),
    ("italian", "prose", ["Il {w} non è per la città della notte. ", "Sono {n} le strade che una {w} conosce. "]),
    ("portuguese", "prose", ["O {w} não é para os dias de chuva. ", "Com {n} horas uma {w} chega em casa. "]),
    ("dutch", "prose", ["Het {w} is niet voor de kinderen van hier. ", "Met {n} dagen is dat {w} al op. "]),
    ("russian", "prose", ["Этот {w} стоит у реки, и он не для детей. ", "Через {n} лет там будет {w} и новый дом. "]),
    ("chinese", "prose", ["这个{w}在河边，是我们的地方。", "过了{n}天，他们的{w}就不在了。"]),
    ("japanese", "prose", ["この{w}は川のそばにあります。", "{n}日後に、あの{w}はもうありません。"]),
    ("go", "code", ["func {w}{n}(x int) error {{\n\tif err := check(x); err != nil {{\n\t\treturn err\n\t}}\n\treturn nil\n}}\n\n"]),
    ("python", "code", ["def {w}_{n}(self, x):\n    if self.{w} is None:\n        return x + {n}\n    return self.{w}(x)\n\n"]),
    ("javascript", "code", ["const {w}{n} = async (x) => {{\n  console.log(x);\n  return await fetch(x, {n});\n}};\n\n"]),
    ("java", "code", ["public class {w}{n} {{\n    private int value = {n};\n    public int get() {{ return value; }}\n}}\n\n"]),
    ("c", "code", ["static int {w}_{n}(const char *s) {{\n    return s ? (int)strlen(s) + {n} : -1;\n}}\n\n"]),
    ("cpp", "code", ["template <typename T> class {w}{n} {{\npublic:\n    std::vector<T> get() const {{ return value_; }}\nprivate:\n    std::vector<T> value_;\n}};\n\n"]),
    ("rust", "code", ["pub fn {w}_{n}(x: u32) -> Option<u32> {{\n    let y = x.checked_add({n})?;\n    Some(y)\n}}\n\n"]),
    ("sql", "code", ["SELECT {w}, count(*) AS n FROM t{n} WHERE {w} > {n} GROUP BY {w};\n"]),
    ("json", "data", ['{{"id": {n}, "name": "{w}", "tags": ["a", "{w}"], "on": true}},\n']),
    ("xml", "data", ['<item id="{n}"><name>{w}</name><price>{n}.50</price></item>\n']),
    ("yaml", "data", ["- id: {n}\n  name: {w}\n  on: true\n"]),
    ("csv", "data", ["{n},{w},{n}.25,open\n"]),
    ("html", "markup", ['<div class="{w}"><h2>Part {n}</h2><p>Some {w} text.</p></div>\n']),
    ("markdown", "markup", ["## Part {n}\n\n- the **{w}**\n- [link](https://example.org/{n})\n\n"]),
    ("latex", "markup", ["\\section{{Part {n}}}\nThe {w} of \\emph{{part {n}}} is here.\n\n"]),
]
WORDS = ["river", "stone", "cloud", "garden", "window", "letter", "market", "engine", "harbor", "signal"]
SIZES_KB = tuple(2**k for k in range(1, 12))
#: What a container adds to one entry: 30 + 46 + 22 bytes, the name twice, two time fields.
CONTAINER = 30 + 46 + 22 + 2 * 9


def generate(spark: SparkSession, sizes_kb: tuple[int, ...] = SIZES_KB) -> DataFrame:
    """(kind, category, size_kb, content): templates by a hash of the line's number, cut at the size in bytes."""
    kinds = spark.createDataFrame([(k, c, t) for k, c, t in KINDS], "kind string, category string, templates array<string>")
    grid = kinds.crossJoin(spark.createDataFrame([(s,) for s in sizes_kb], "size_kb int"))
    # Lines of 20 bytes or more: as many numbers as that needs at most, made where the row is.
    pick = lambda a, i, salt: F.element_at(a, (F.pmod(F.xxhash64(i, F.lit(salt)), F.size(a)) + 1).cast("int"))
    words = F.array(*map(F.lit, WORDS))
    line = lambda i: F.replace(F.replace(F.replace(F.replace(pick(F.col("templates"), i, 1), F.lit("{n}"), F.pmod(F.xxhash64(i, F.lit(2)), F.lit(1000)).cast("string")), F.lit("{w}"), pick(words, i, 3)), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    n = (F.col("size_kb") * 1024 / 15).cast("int") + 1
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), line), "")
    return grid.repartition("kind", "size_kb").select("kind", "category", "size_kb", F.substring(F.encode(text, "UTF-8"), F.lit(1), F.col("size_kb") * 1024).alias("content"))


def measure(content: DataFrame, vocabularies: dict[str, tuple[bytes, ...]]) -> DataFrame:
    """Per blob: sizes of plain DEFLATE, tokens with DEFLATE (text vocabulary), the chosen method, and gains in percent."""
    text = vocabularies["text"]

    def tokens_deflated(data: bytes) -> bytes:
        return choose.encode(data, codecs.DEFLATE_TOKENS, text)

    keep = ["kind", "category", "size_kb"]
    chosen = choose.compress(content, "content", [*keep, "content"], vocabularies)
    out = chosen.select(*keep, F.col("size").alias("original"), (F.col("packed_size") + CONTAINER).alias("packed"), "method", F.octet_length(codecs.deflate_raw("content")).cast("long").alias("deflate_only"), F.octet_length(codecs._udf(tokens_deflated)("content")).cast("long").alias("tokens_only"))
    return derived(out)


def derived(sizes: DataFrame) -> DataFrame:
    """Ratios, the gain over a plain archive, and whether the packed form is no larger."""
    plain = F.col("deflate_only") + CONTAINER
    return sizes.withColumn("ratio", F.round(F.col("packed") * 100 / F.greatest(F.col("original"), F.lit(1)), 6)).withColumn("plain_ratio", F.round(plain * 100 / F.greatest(F.col("original"), F.lit(1)), 6)).withColumn("gain", F.round((plain - F.col("packed")) * 100 / plain, 6)).withColumn("wins", F.col("packed") <= plain)


def summary(measured: DataFrame) -> DataFrame:
    """(category, size_kb, tests, wins, mean_gain): overall, by category and by size, from one grouping-sets aggregation."""
    measured.createOrReplaceTempView("__grid")
    return measured.sparkSession.sql("""
        SELECT category, size_kb, count(*) AS tests, count_if(wins) AS wins, round(avg(gain), 6) AS mean_gain
        FROM __grid GROUP BY GROUPING SETS ((), (category), (size_kb))""")


def parsed_sizes(text: Column) -> Column:
    """The sizes named in a list such as 64,2,16, in ascending order."""
    return F.array_sort(F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int")))


def filtered(measured: DataFrame, category: str = "", size_kb: int | None = None) -> DataFrame:
    """The rows of a category and of a size; an empty choice takes all."""
    out = measured.where(F.col("category") == category) if category else measured
    return out if size_kb is None else out.where(F.col("size_kb") == size_kb)


def tenths(x: Column) -> Column:
    """A double with one decimal as C prints it: rounded by its exact binary value, ties to the even digit; null stays null. (The
    JVM rounds its shortest decimal form, ties up.)"""
    v = F.abs(x)
    k = F.floor(v * 10)
    # 20 v against 2 k + 1, the middle: 16 v, 4 v and the difference of numbers this near are exact.
    over = (16 * v - (2 * k + 1)) + 4 * v
    up = F.when((over > 0) | (over == 0) & (k % 2 == 1), k + 1).otherwise(k)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(up / 10).cast("string"), F.lit("."), (up % 10).cast("string"))


def formatted(measured: DataFrame, *keep: str) -> DataFrame:
    """The figures of a report as it prints them: percent and kilobytes with one decimal, whether there is a gain, and the
    category's style name."""
    kb = lambda x: tenths(F.col(x) / 1024)
    return measured.select(*keep, tenths(F.col("gain")).alias("gain_pct"), kb("original").alias("original_kb"), kb("packed").alias("packed_kb"), (F.col("gain") > 0).alias("positive"), F.lower("category").alias("style"))


def report(measured: DataFrame, path: str) -> None:
    """The facts and their roll-ups as JSON lines."""
    measured.write.mode("overwrite").json(f"{path}/facts")
    summary(measured).write.mode("overwrite").json(f"{path}/summary")


def throughput(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bytes of a stream of content batches, for benches."""
    rows = size = 0
    for b in batches:
        rows += b.num_rows
        size += b.nbytes
    yield pa.record_batch([pa.array([rows]), pa.array([size])], ["rows", "bytes"])
