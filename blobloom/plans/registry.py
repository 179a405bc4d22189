"""Queries of the library's own operators and their SQL.

Each query reads whole tables. Profiles look at a blob's first 8,192 bytes, because
that is what a profile is; everything else takes whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesx, rules
from ..operators import choose, codecs, profile, vocabulary
from ..session import prepare
from ..sources import archives, zipformat
from . import grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def sampled(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> DataFrame:
    """key, the sample s, its Latin-1 view l1 and its text t."""
    s = read(spark, sf_dir, table).select(key, bytesx.sample(bytesx.as_bytes(F.coalesce(text, F.lit("")))).alias("s"))
    return s.select(key, "s", bytesx.latin1(c("s")).alias("l1"), bytesx.lenient_text(c("s")).alias("t"))


def sql_sample(table: str, key: str, text: str) -> str:
    """The same in SQL: b are the bytes, n their number, t the text, lo and tr its lower case and trimmed form."""
    cuts = ", ".join(f"try(decode(e[1:{n}]))" for n in range(8192, 8188, -1))
    space = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return f"""WITH raw AS (SELECT {key}, encode(coalesce({text}, '')) AS e FROM {table}),
s AS (SELECT {key}, e[1:8192] AS b, least(octet_length(e), 8192) AS n, coalesce({cuts}) AS t FROM raw),
x AS (SELECT *, lower(t) AS lo, regexp_replace(t, '^{space}+|{space}+$', '', 'g') AS tr, hex(b) AS h FROM s)"""


SR = rules.SqlRules()
BYTES = ", bytes AS (SELECT {key}, ('0x' || substr(h, 2 * i + 1, 2))::INT AS byte, i FROM (SELECT {key}, h, unnest(range(n)) AS i FROM x))"
SQL_ASCII = "coalesce(length(regexp_replace(t, '[^\\x20-\\x7E\\t\\n\\r]', '', 'g')) / nullif(n, 0), 0)"


def sql_share(chars: str) -> str:
    return f"(length(t) - length(translate(t, {rules.sql_text(chars)}, ''))) / nullif(n, 0)"


SQL_TENTHS = "CASE WHEN n = 0 THEN 0 ELSE least(10, " + " + ".join(f"CASE WHEN {sql_share(ch)} {'>' if s > 0 else '<'} {abs(s)} THEN {t} ELSE 0 END" for ch, s, t in profile.CODE_SIGNS) + ") END"
SQL_NAT = "CASE " + " ".join(f"WHEN regexp_matches(lo, '[\\x{{{a:X}}}-\\x{{{b:X}}}]') THEN '{n}'" for n, a, b in rules.SCRIPTS) + " ELSE " + rules.sql_best({n: SR.points([(1, w) for w in ws], "lo") for n, ws in rules.WORDS.items()}, rules.MIN_WORDS) + " END"
_own = {n: SR.points(r) for n, r in rules.CODE.items()}
SQL_CODE = {n: f"({s} + {_own[rules.BUILDS_ON[n]]})" if n in rules.BUILDS_ON else s for n, s in _own.items()}
DOCS = sql_sample("documents", "doc_id", "text")


# -- profiles


@query(DOCS + BYTES.format(key="doc_id") + " SELECT doc_id, byte, count(*) AS cnt FROM bytes GROUP BY doc_id, byte")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampled(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", F.posexplode(profile.histogram("s")).alias("byte", "cnt")).where("cnt > 0")


@query(DOCS + BYTES.format(key="doc_id") + " SELECT doc_id, count(DISTINCT byte)::INT AS unique_bytes FROM x LEFT JOIN bytes USING (doc_id) GROUP BY doc_id")
def unique_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", profile.byte_stats("s")["unique_bytes"].alias("unique_bytes"))


SQL_ENTROPY = BYTES.format(key="doc_id") + ", hist AS (SELECT doc_id, byte, count(*) AS k FROM bytes GROUP BY doc_id, byte), ent AS (SELECT doc_id, round(-sum(k / n * log2(k / n)), 6) + 0.0 AS entropy, count(*)::INT AS u FROM hist JOIN x USING (doc_id) GROUP BY doc_id)"


@query(DOCS + SQL_ENTROPY + " SELECT doc_id, coalesce(entropy, 0.0) AS entropy FROM x LEFT JOIN ent USING (doc_id)")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(profile.byte_stats("s")["entropy"], 6).alias("entropy"))


@query(DOCS + f" SELECT doc_id, round({SQL_ASCII}, 6) AS ascii_ratio FROM x")
def ascii_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(profile.ascii_ratio(c("l1")), 6).alias("ascii_ratio"))


SQL_REPEAT = "CASE WHEN n < 8 THEN 0.0 ELSE 1 - len(list_distinct([substr(h, 4 * i + 1, 8) FOR i IN range(0, (n - 4) // 2 + 1)])) / ((n - 4) // 2 + 1) END"


@query(DOCS + f" SELECT doc_id, round({SQL_REPEAT}, 6) AS repetition_rate FROM x")
def repetition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(profile.byte_stats("s")["repetition_rate"], 6).alias("repetition_rate"))


@query(DOCS + f" SELECT doc_id, ({SQL_TENTHS})::INT AS code_tenths FROM x")
def code_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", rules.bind(c("l1"), profile.code_tenths).alias("code_tenths"))


def _labels(table: str, key: str, text: str, name: str, spark_label: Callable[[Column], Column], sql_label: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sampled(spark, sf_dir, table, key, text).select(key, spark_label(c("t")).alias("label"))

    run.__name__ = name
    query(sql_sample(table, key, text) + f" SELECT {key}, {sql_label} AS label FROM x")(run)


_labels("documents", "doc_id", "text", "data_format", profile.data_format, SR.first(rules.FORMATS))
_labels("events", "event_id", "props", "data_format_events", profile.data_format, SR.first(rules.FORMATS))
_labels("documents", "doc_id", "text", "markup", profile.markup, SR.first(rules.MARKUP))
_labels("pages", "page_id", "html", "markup_pages", profile.markup, SR.first(rules.MARKUP))
_labels("documents", "doc_id", "text", "nat_lang", profile.nat_language, SQL_NAT)
_labels("benchmark", "item_id", "text", "nat_lang_benchmark", profile.nat_language, SQL_NAT)
_labels("pages", "page_id", "html", "code_lang_pages", profile.code_language, rules.sql_best(SQL_CODE, rules.MIN_CODE))


@query(DOCS + SQL_ENTROPY + f" SELECT lang, {SQL_NAT} AS nat_lang, count(*) AS docs, round(avg(coalesce(entropy, 0)), 6) AS mean_entropy FROM x LEFT JOIN ent USING (doc_id) JOIN documents USING (doc_id) GROUP BY ALL")
def nat_lang_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("lang", bytesx.sample(bytesx.as_bytes(F.coalesce("text", F.lit("")))).alias("s"))
    rows = s.select("lang", profile.nat_language(bytesx.lenient_text(c("s"))).alias("nat_lang"), F.round(profile.byte_stats("s")["entropy"], 6).alias("e"))
    return rows.groupBy("lang", "nat_lang").agg(F.count("*").alias("docs"), F.round(F.avg("e"), 6).alias("mean_entropy"))


#: Snippets of our own; the tables hold no source code.
SNIPPETS = {
    "go": "package box\n\nfunc Lid(n int) error {\n\tdefer shut()\n\tx := n\n\treturn nil\n}\n",
    "python": "from box import lid\n\nclass Box:\n    def __init__(self):\n        self.lid = None\n",
    "js": "const lid = require('box');\nexport const open = async (x) => {\n  console.log(x);\n};\n",
    "java": "import java.util.List;\n\npublic class Box {\n    private int lid;\n    @Override public String toString() { return null; }\n}\n",
    "c": '#include <stdio.h>\n#define LID 1\nint main(void) { printf("%d", LID); return 0; }\n',
    "cpp": "#include <iostream>\nnamespace box { class Lid { public: virtual ~Lid() {} }; }\nint main() { std::cout << 1; }\n",
    "cs": "using System;\nnamespace Box { class Lid { public int N { get; set; } } }\n",
    "ruby": "require 'box'\nclass Lid\n  attr_accessor :n\n  def open\n    puts n unless n.nil?\n  end\nend\n",
    "rust": "use std::fmt;\npub fn lid(n: u32) -> Option<u32> { let mut x = n; println!(\"{}\", x); Some(x) }\n",
    "php": "<?php\nfunction lid($n) { echo $this->n; return array($n); }\n",
    "swift": "import Foundation\nstruct Lid { var n: Int }\nfunc open(_ x: Int) -> Int { guard x > 0 else { return 0 }; let y: Int = x; return y }\n",
    "kotlin": "data class Lid(val n: Int)\nfun main() { println(\"x\"); val y: Int? = null; y?.let { } }\n",
    "prose": "The lid of the box was closed for the night, and that was that.\n",
    "json": '{"lid": {"n": 1}, "on": true}\n', "toml": "[lid]\nn = 1\n", "ini": "[lid]\nn=1\n", "yaml": "---\nlid: 1\nbox: 2\n", "csv": "a,b\n1,2\n", "xml": "<?xml version=\"1.0\"?><lid/>\n",
    "rst": "Lid\n====\n\n.. note:: a box\n", "adoc": "= Lid\n\n== Box\n", "org": "* Lid\n", "tex": "\\documentclass{article}\n", "rtf": "{\\rtf1 box}", "empty": "",
}
_values = "(VALUES " + ", ".join(f"('{k}', {rules.sql_text(v)})" for k, v in SNIPPETS.items()) + ") v(case_id, text)"
SNIPPET_SQL = sql_sample(f"(SELECT * FROM {_values})", "case_id", "text")


def snippets(spark: SparkSession) -> DataFrame:
    return prepare(spark).createDataFrame(list(SNIPPETS.items()), "case_id string, text string").select("case_id", c("text").alias("t"))


@query(SNIPPET_SQL + " SELECT case_id, lang, score FROM (" + " UNION ALL ".join(f"SELECT case_id, '{n}' AS lang, {s} AS score FROM x" for n, s in SQL_CODE.items()) + ")")
def code_lang_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark).select("case_id", F.inline(profile.code_scores(c("t"))))


@query(SNIPPET_SQL + f" SELECT case_id, {rules.sql_best(SQL_CODE, rules.MIN_CODE)} AS language, {SR.first(rules.FORMATS)} AS data_fmt, {SR.first(rules.MARKUP)} AS markup FROM x")
def code_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark).select("case_id", profile.code_language(c("t")).alias("language"), profile.data_format(c("t")).alias("data_fmt"), profile.markup(c("t")).alias("markup"))


_wide = DOCS + SQL_ENTROPY + f""", w AS (SELECT x.doc_id, n, {SR.first(rules.FORMATS)} AS data_fmt, {SR.first(rules.MARKUP)} AS markup, {SQL_ASCII} AS ascii_ratio, {SQL_TENTHS} AS code_tenths, {SQL_REPEAT} AS rep, coalesce(entropy, 0) AS entropy, coalesce(u, 0) AS u FROM x LEFT JOIN ent USING (doc_id)),
ty AS (SELECT doc_id, CASE WHEN n = 0 THEN 'random' WHEN data_fmt <> 'None' THEN 'code' WHEN markup = 'HTML' AND code_tenths >= 4 THEN 'code' WHEN markup <> 'None' THEN 'text'
  WHEN ascii_ratio > 0.85 AND code_tenths >= 4 THEN 'code' WHEN ascii_ratio > 0.85 THEN 'text' WHEN rep > 0.3 THEN 'repetitive' WHEN entropy < 5 THEN 'low-entropy'
  WHEN entropy > 7.5 AND u > 250 THEN 'random' ELSE 'binary' END AS type FROM w)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(read(spark, sf_dir, "documents"), bytesx.as_bytes(c("text")), ["doc_id", "source"])


@query(_wide + " SELECT doc_id, type FROM ty")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("doc_id", "type")


@query(_wide + " SELECT source, type, count(*) AS docs FROM ty JOIN documents USING (doc_id) GROUP BY ALL")
def profile_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).groupBy("source", "type").agg(F.count("*").alias("docs"))


# -- vocabularies and tokens

_words_sql = "w AS (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS token FROM benchmark), v AS (SELECT token, -count(*) AS rank FROM w WHERE token <> '' GROUP BY token)"


def _word_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \n]+")).alias("token")).where("token <> ''")
    return words.groupBy("token").agg((-F.count("*")).alias("rank"))


#: Bytes of a vocabulary's sample at most, and its tokens beyond the single bytes.
SAMPLE, TOKENS = 64 << 10, {"text": 1000, "go": 1500, "python": 1500, "javascript": 1500}
_trained: dict[tuple, tuple[bytes, ...]] = {}


def _trained_on(name: str, blobs: list[bytes], merges: int) -> tuple[bytes, ...]:
    key = (name, merges, hash(tuple(blobs)))
    if key not in _trained:
        _trained[key] = vocabulary.train_local(blobs, merges)
    return _trained[key]


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[bytes, ...]:
    """The text vocabulary: trained on a bounded sample of the benchmark table."""
    rows = read(spark, sf_dir, "benchmark").where("text is not null").orderBy(F.xxhash64("text"), "text").select("text", F.octet_length("text").alias("n"))
    some, size = [], 0
    for r in rows.limit(SAMPLE // 16).toLocalIterator():
        if size + r["n"] > SAMPLE:
            break
        some.append(r["text"].encode())
        size += r["n"]
    return _trained_on("text", some, TOKENS["text"])


@query("WITH " + _words_sql + " SELECT token, row_number() OVER (ORDER BY rank, encode(token)) - 1 AS id FROM v")
def vocab_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _word_ranks(spark, sf_dir).select(bytesx.as_bytes(c("token")).alias("token"), "rank")
    return vocabulary.renumber(ranks).select(c("token").cast("string").alias("token"), c("id").cast("long").alias("id"))


@query("WITH " + _words_sql + " SELECT count(*) AS size, max(octet_length(encode(token))) AS max_len FROM v")
def vocab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.stats(_word_ranks(spark, sf_dir).select(bytesx.as_bytes(c("token")).alias("token"))).select("size", c("max_len").cast("long").alias("max_len"))


@query("SELECT format('{:02X}', i) AS token, i::INT AS rank FROM range(256) t(i)")
def basic_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.basic(spark).select(F.hex("token").alias("token"), "rank")


@query("WITH " + _words_sql + " SELECT token, (1000 + rank)::INT AS rank FROM v")
def tiktoken_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _word_ranks(spark, sf_dir).select(F.concat_ws(" ", F.base64(bytesx.as_bytes(c("token"))), (c("rank") + 1000).cast("string")).alias("value"))
    # Lines of one field are skipped, and a token's last line wins.
    extra = spark.createDataFrame([("",), ("only-one-field",)], "value string")
    early = lines.select(F.concat(F.split("value", " ")[0], F.lit(" 999999")).alias("value"))
    return vocabulary.load_tiktoken(extra.unionByName(early).unionByName(lines)).select(c("token").cast("string").alias("token"), "rank")


_escape_sql = "[CASE b WHEN 92 THEN chr(92) || chr(92) WHEN 34 THEN chr(92) || chr(34) WHEN 10 THEN chr(92) || 'n' WHEN 13 THEN chr(92) || 'r' WHEN 9 THEN chr(92) || 't' ELSE CASE WHEN b BETWEEN 32 AND 126 THEN chr(b::INT) ELSE chr(92) || 'x' || lower(format('{:02X}', b)) END END FOR b IN bs]"


@query("WITH " + _words_sql + f", x AS (SELECT token, rank, hex(encode(token)) AS h FROM v), y AS (SELECT rank, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)] AS bs FROM x) SELECT rank, chr(34) || array_to_string({_escape_sql}, '') || chr(34) || ': ' || rank || ',' AS line FROM y")
def vocab_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.literals(_word_ranks(spark, sf_dir).select(bytesx.as_bytes(c("token")).alias("token"), "rank"))


FEW = ["the ", "the", "and ", " of ", "ing", "tion", "er", "en", "he", " de "]
FEW += "th in re on an at nd st es ou ea hat ent ion for wh sh ed ly ble erth que eau ai ou le la les de des du une qu ment ieux os as con que el los una ción do ra sch und ein ich der die das ge ver ung be te".split()
FEW = list(dict.fromkeys(FEW))
_few = tuple(bytes([i]) for i in range(256)) + tuple(w.encode() for w in FEW)
_few_regex = "|".join(sorted(FEW, key=lambda w: (-len(w), w)))
_pieces_sql = f"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?s){_few_regex}|.')) AS piece FROM documents)"


def _pieces(spark: SparkSession, sf_dir: str, single: bool = True) -> DataFrame:
    l1 = bytesx.latin1(bytesx.as_bytes(F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "documents").select("doc_id", vocabulary.encode_regex(l1, tuple(t for t in _few if len(t) > 1), single).alias("p"))


@query(_pieces_sql + " SELECT documents.doc_id, coalesce(sum(CASE WHEN length(piece) > 1 THEN 1 ELSE octet_length(encode(piece)) END), 0)::BIGINT AS n_tokens, count_if(length(piece) > 1) AS n_long FROM documents LEFT JOIN p ON documents.doc_id = p.doc_id GROUP BY documents.doc_id")
def greedy_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", F.size("p").cast("long").alias("n_tokens"), F.size(F.filter("p", lambda x: F.length(x) > 1)).cast("long").alias("n_long"))


@query(_pieces_sql + " SELECT documents.doc_id, coalesce(sum(CASE WHEN length(piece) > 1 THEN 1 ELSE octet_length(encode(piece)) END), 0)::BIGINT AS n_tokens FROM documents LEFT JOIN p ON documents.doc_id = p.doc_id GROUP BY documents.doc_id")
def trie_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", bytesx.as_bytes(F.coalesce("text", F.lit(""))).alias("b"))
    return docs.select("doc_id", F.size(vocabulary.encoder(_few)("b")).cast("long").alias("n_tokens"))


@query(_pieces_sql + " SELECT piece, count(*) AS cnt FROM p WHERE length(piece) > 1 GROUP BY piece ORDER BY cnt DESC, piece LIMIT 5")
def token_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pieces of one byte aren't asked for, and what the long ones are doesn't depend on them.
    counts = _pieces(spark, sf_dir, False).select(F.explode("p").alias("piece")).groupBy("piece").agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "piece").limit(5)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(bytesx.latin1(bytesx.as_bytes(c("text"))).alias("z"))


_pair_hex = lambda: F.hex(F.encode("pair", "ISO-8859-1"))
_pairs_sql = "WITH h AS (SELECT hex(encode(text)) AS h FROM documents), p AS (SELECT substr(h, 2 * i + 1, 4) AS pair FROM (SELECT h, unnest(range(length(h) // 2 - 1)) AS i FROM h)), n AS (SELECT pair, count(*) AS n FROM p GROUP BY pair)"


@query(_pairs_sql + " SELECT pair, n FROM n")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.pair_counts(_symbols(spark, sf_dir)).select(_pair_hex().alias("pair"), "n")


@query(_pairs_sql + """, top AS (SELECT pair, n FROM n ORDER BY n DESC, pair LIMIT 1)
SELECT pair, n, (SELECT sum(octet_length(encode(text)) - (length(text) - length(replace(text, decode(unhex(pair)), ''))) / 2) FROM documents)::BIGINT AS symbols FROM top""")
def merge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _symbols(spark, sf_dir)
    top = vocabulary.pair_counts(z).orderBy(F.desc("n"), "pair").limit(1)
    # The winner is one row, so its broadcast is bounded.
    merged = z.join(F.broadcast(top)).select(_pair_hex().alias("pair"), "n", F.length(F.replace("z", "pair", F.lit(chr(256)))).alias("len"))
    return merged.groupBy("pair", "n").agg(F.sum("len").alias("symbols"))


@query("SELECT item_id, true AS ok FROM benchmark")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", bytesx.as_bytes(F.coalesce("text", F.lit(""))).alias("b"))
    tokens = _tokens(spark, sf_dir)
    vocab = spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(tokens)], "token binary, rank int")
    back = vocabulary.decode(rows.select("item_id", vocabulary.encoder(tokens)("b").alias("ids")), vocab, "item_id")
    return rows.join(back, "item_id").select("item_id", (c("b") == c("content")).alias("ok"))


_ids = lambda: F.array(c("doc_id").cast("int"), c("n_chars").cast("int"), (c("n_chars") * 997).cast("int"))
_size_sql = lambda x: f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END"


@query("SELECT doc_id, (" + " + ".join(_size_sql(x) for x in ("doc_id", "n_chars", "n_chars * 997")) + ")::BIGINT AS size FROM documents")
def varint_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", vocabulary.varint_size(_ids()).alias("size"))


def _varint_sql(x: str) -> str:
    b = lambda k, more: f"format('{{:02X}}', (({x} >> {7 * k}) & 127) | {128 if more else 0})"
    whens = " ".join(f"WHEN {x} < {1 << 7 * n} THEN " + " || ".join(b(k, k < n - 1) for k in range(n)) for n in range(1, 5))
    return f"CASE {whens} ELSE " + " || ".join(b(k, k < 4) for k in range(5)) + " END"


@query("SELECT doc_id, " + " || ".join(_varint_sql(x) for x in ("doc_id", "n_chars", "(n_chars * 997)")) + " AS packed FROM documents")
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.hex(vocabulary.varint_bytes(_ids())).alias("packed"))


@query("SELECT doc_id, true AS ok FROM documents")
def varint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", (codecs.varint_decode(vocabulary.varint_bytes(_ids())) == _ids()).alias("ok"))


#: Of a vocabulary; training ends before where no pair occurs twice.
MERGES = 1000


@query()
def train_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vocabulary.train(read(spark, sf_dir, "benchmark"), bytesx.as_bytes(c("text")), MERGES)
    return made.select(F.hex("token").alias("token"), "rank")


# -- codecs

_bench_bytes = sql_sample("benchmark", "item_id", "text").replace("e[1:8192] AS b, least(octet_length(e), 8192) AS n", "e AS b, octet_length(e) AS n") + BYTES.format(key="item_id") + ", hist AS (SELECT item_id, byte, count(*) AS k, sum(count(*)) OVER (PARTITION BY item_id) AS total FROM bytes GROUP BY item_id, byte)"
_rans_sql = _bench_bytes + """, f AS (SELECT *, greatest(1, floor(k * 16384 / total))::BIGINT AS f FROM hist),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY f DESC, byte) AS r, sum(f) OVER (PARTITION BY item_id) AS fs FROM f),
t AS (SELECT item_id, byte, k, (CASE WHEN r = 1 THEN f + 16384 - fs ELSE f END)::BIGINT AS freq FROM r)"""


def _byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", bytesx.as_bytes(F.coalesce("text", F.lit(""))).alias("b"))
    return rows.select("item_id", F.posexplode(profile.histogram("b")).alias("byte", "n")).where("n > 0")


@query(_rans_sql + " SELECT item_id, byte, freq, coalesce(sum(freq) OVER (PARTITION BY item_id ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM t")
def rans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.rans_table(_byte_counts(spark, sf_dir), "item_id", "byte", "n")


@query(_rans_sql + " SELECT item_id, (ceil(round(sum(k * -log2(freq / 16384)) / 8, 6)) + 520)::BIGINT AS size FROM t GROUP BY item_id")
def rans_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _byte_counts(spark, sf_dir)
    return codecs.rans_size(codecs.rans_table(counts, "item_id", "byte", "n"), counts, "item_id", "byte", "n")


def _blobs(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return read(spark, sf_dir, table).select(key, bytesx.as_bytes(F.coalesce("text", F.lit(""))).alias("b"))


@query("SELECT doc_id, true AS ok FROM documents")
def rans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blobs(spark, sf_dir, "documents", "doc_id").withColumn("p", codecs.rans_pack("b"))
    return rows.select("doc_id", (codecs.rans_unpack("p") == c("b")).alias("ok"))


@query("SELECT doc_id, true AS ok FROM documents")
def chunked_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blobs(spark, sf_dir, "documents", "doc_id")
    back = codecs.joined(codecs.chunked(rows, "doc_id", "b", 16 << 10), "doc_id")
    return rows.join(back, "doc_id").select("doc_id", (c("b") == c("content")).alias("ok"))


@query("SELECT doc_id, true AS ok, true AS no_larger FROM documents")
def deflate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blobs(spark, sf_dir, "documents", "doc_id").withColumn("p", codecs.deflate_raw("b"))
    # DEFLATE adds 5 bytes for each stored block of 64 KB at most.
    return rows.select("doc_id", (codecs.inflate_raw("p") == c("b")).alias("ok"), (F.octet_length("p") <= F.octet_length("b") + 16 + F.octet_length("b") / 1000).alias("no_larger"))


@query()
def deflate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir, "documents", "doc_id").select("doc_id", F.octet_length("b").alias("size"), F.octet_length(codecs.deflate_raw("b")).alias("packed"))


_crc_sql = """WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))),
b AS (SELECT conv_id, turn, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)] AS bytes FROM (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS h FROM conversations))
SELECT conv_id, turn, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) AS crc FROM b, tab"""


@query(_crc_sql)
def crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", bytesx.as_bytes(F.coalesce("text", F.lit(""))).alias("b"))
    return rows.select("conv_id", "turn", codecs.crc32(c("b")).alias("crc"))


#: Range coding step by step: a state x and the bytes o it has given off, in hexadecimal.
_rans_bytes_sql = _rans_sql + """, cums AS (SELECT item_id, byte, freq, coalesce(sum(freq) OVER (PARTITION BY item_id ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM t),
cells AS (SELECT i.item_id AS item_id, v, coalesce(freq, 0)::BIGINT AS freq, coalesce(cum, 0)::BIGINT AS cum FROM (SELECT DISTINCT item_id FROM cums) i CROSS JOIN range(256) r(v) LEFT JOIN cums ON cums.item_id = i.item_id AND cums.byte = v),
tabs AS (SELECT item_id, list(freq ORDER BY v) AS f, list(cum ORDER BY v) AS k FROM cells GROUP BY item_id),
back AS (SELECT item_id, [{'x': ('0x' || substr(h, 2 * (n - i) - 1, 2))::BIGINT, 'o': ''} FOR i IN range(n)] AS bytes, n FROM (SELECT item_id, h, length(h) // 2 AS n FROM x) WHERE n > 0),
coded AS (SELECT item_id, n, f, list_reduce(bytes, lambda a, s: {
  'x': (((a.x >> CASE WHEN a.x >= 131072 * f[s.x + 1] THEN CASE WHEN (a.x >> 8) >= 131072 * f[s.x + 1] THEN 16 ELSE 8 END ELSE 0 END) // f[s.x + 1]) << 14)
       + (a.x >> CASE WHEN a.x >= 131072 * f[s.x + 1] THEN CASE WHEN (a.x >> 8) >= 131072 * f[s.x + 1] THEN 16 ELSE 8 END ELSE 0 END) % f[s.x + 1] + k[s.x + 1],
  'o': CASE WHEN a.x >= 131072 * f[s.x + 1] THEN CASE WHEN (a.x >> 8) >= 131072 * f[s.x + 1] THEN format('{:02X}', (a.x >> 8) & 255) ELSE '' END || format('{:02X}', a.x & 255) ELSE '' END || a.o}, {'x': 8388608::BIGINT, 'o': ''}) AS r FROM back JOIN tabs USING (item_id)),
le AS (SELECT item_id, format('{:02X}{:02X}{:02X}{:02X}', n & 255, (n >> 8) & 255, (n >> 16) & 255, n >> 24) || array_to_string([format('{:02X}{:02X}', v & 255, v >> 8) FOR v IN f], '')
  || format('{:02X}{:02X}{:02X}{:02X}', r.x & 255, (r.x >> 8) & 255, (r.x >> 16) & 255, r.x >> 24) || r.o AS packed FROM coded)"""


@query(_rans_bytes_sql + " SELECT x.item_id, coalesce(packed, '00000000') AS packed FROM x LEFT JOIN le ON x.item_id = le.item_id")
def rans_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir, "benchmark", "item_id").select("item_id", F.hex(codecs.rans_pack("b")).alias("packed"))


def _vocabularies(spark: SparkSession, sf_dir: str) -> dict[str, tuple[bytes, ...]]:
    """Text, and one vocabulary for each language that has its own, trained on generated code of it."""
    out = {"text": _tokens(spark, sf_dir)}
    code = {r["kind"]: bytes(r["content"]) for r in grid.generate(spark, (SAMPLE >> 10,)).where(c("kind").isin(list(zipformat.VOCAB_CODES))).collect()}
    return out | {k: _trained_on(k, [code[k]], TOKENS[k]) for k in zipformat.VOCAB_CODES if k in code}


@query("SELECT name, max_len >= 2 AS longer, size > 256 AS more FROM (VALUES " + ", ".join(f"('{n}', 2, 257)" for n in zipformat.VOCAB_CODES) + ") v(name, max_len, size)")
def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _vocabularies(spark, sf_dir)
    rows = spark.createDataFrame([(n, bytearray(t), i) for n, x in made.items() for i, t in enumerate(x)], "name string, token binary, rank int")
    return rows.groupBy("name").agg((F.max(F.octet_length("token")) >= 2).alias("longer"), (F.count("*") > 256).alias("more"))


@query()
def method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = choose.compress(_blobs(spark, sf_dir, "documents", "doc_id"), "b", ["doc_id"], _vocabularies(spark, sf_dir))
    return made.select("doc_id", "type", "vocabulary", "method", "size", "packed_size")


@query(f"SELECT method, count(*) AS blobs, true AS ok FROM conversations, (VALUES {', '.join(f'({m})' for m in choose.NAMES)}) v(method) GROUP BY method")
def method_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vocab = read(spark, sf_dir, "conversations").select("conv_id", "turn", bytesx.as_bytes(F.coalesce("text", F.lit(""))).alias("b")), _vocabularies(spark, sf_dir)
    out = None
    for m in choose.NAMES:
        made = choose.compress(rows, "b", ["conv_id", "turn"], vocab, method=m)
        good = choose.restore(made, ["conv_id", "turn", "method"], vocab).groupBy(c("method").cast("int").alias("method")).agg(F.count("*").alias("blobs"), (F.count("error") == 0).alias("ok"))
        out = good if out is None else out.unionByName(good)
    return out


# -- archives


def _archives(spark: SparkSession, sf_dir: str, folder: bool = True) -> tuple[DataFrame, dict[str, tuple[bytes, ...]]]:
    vocab = _vocabularies(spark, sf_dir)
    turns = read(spark, sf_dir, "conversations")
    rows = turns.select(c("conv_id").alias("archive_id"), (c("turn") + 1).cast("int").alias("ordinal"), F.format_string("turns/%04d-%s.txt", "turn", "role").alias("name"), F.lit("file").alias("kind"), bytesx.as_bytes(c("text")).alias("content"), F.lit(None).cast("string").alias("link_target"), F.timestamp_seconds(F.lit(1_700_000_000) + c("turn")).alias("mtime"), F.lit(0o644).alias("mode"))
    dirs = turns.select(c("conv_id").alias("archive_id")).distinct().select("archive_id", F.lit(0).alias("ordinal"), F.lit("turns").alias("name"), F.lit("dir").alias("kind"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("link_target"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("mtime"), F.lit(0o755).alias("mode"))
    return archives.pack(archives.encode_entries(rows.unionByName(dirs) if folder else rows, vocab)), vocab


_entries_sql = """SELECT conv_id AS archive_id, (turn + 1)::INT AS ordinal, format('turns/{:04d}-{}.txt', turn, role) AS name, octet_length(encode(text))::BIGINT AS size, 1700000000 + turn AS mtime, 33188 AS mode FROM conversations
UNION ALL SELECT DISTINCT conv_id, 0, 'turns/', 0, 1700000000, 16877 FROM conversations"""


@query(_entries_sql)
def zip_write_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _archives(spark, sf_dir)
    return archives.list_entries(made, "archive_id").select("archive_id", "ordinal", "name", "size", F.unix_timestamp("mtime").alias("mtime"), "mode")


@query("SELECT conv_id AS archive_id, count(*) AS entries, 0::BIGINT AS errors FROM conversations GROUP BY conv_id")
def zip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, vocab = _archives(spark, sf_dir)
    return archives.test_archives(made, "archive_id", vocab)


@query("SELECT event_id AS archive_id, event_type || '.json' AS name, octet_length(encode(props))::BIGINT AS size, props AS text FROM events")
def single_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = _vocabularies(spark, sf_dir)
    made = archives.single(read(spark, sf_dir, "events"), "event_id", F.concat("event_type", F.lit(".json")), bytesx.as_bytes(c("props")), vocab)
    return archives.read_entries(made, "archive_id", vocab).select("archive_id", "name", F.octet_length("data").cast("long").alias("size"), c("data").cast("string").alias("text"))


@query("SELECT conv_id AS archive_id, format('turns/{:04d}-{}.txt', turn, role) AS name, text FROM conversations WHERE role = 'assistant'")
def zip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, vocab = _archives(spark, sf_dir)
    return archives.read_entries(made, "archive_id", vocab, ["*-assistant.txt"]).select("archive_id", "name", c("data").cast("string").alias("text"))


_listing_sql = "SELECT source AS archive, doc_id::VARCHAR AS name, octet_length(encode(text))::BIGINT AS size, length(text)::BIGINT AS comp_size FROM documents"


def _entry_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(c("source").alias("archive"), c("doc_id").cast("string").alias("name"), F.octet_length("text").cast("long").alias("size"), F.length("text").cast("long").alias("comp_size"))


_ratio_sql = "CASE WHEN size > 0 THEN 100 - (comp_size * 100) // size ELSE 0 END"


@query(f"WITH e AS ({_listing_sql}), t AS (SELECT archive, count(*) AS n, sum(size)::BIGINT AS size, sum(comp_size)::BIGINT AS comp_size FROM e GROUP BY archive) SELECT archive, n, size, comp_size, ({_ratio_sql})::BIGINT AS ratio FROM t")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.listing(_entry_sizes(spark, sf_dir), "archive").where("name is null").drop("name")


@query(f"WITH e AS ({_listing_sql}) SELECT archive, name, greatest(0, {_ratio_sql})::BIGINT AS ratio FROM e")
def listing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.listing(_entry_sizes(spark, sf_dir), "archive").where("name is not null").select("archive", "name", "ratio")


@query("SELECT count(*) AS entries, sum(octet_length(encode(text)))::BIGINT AS size, sum(length(text))::BIGINT AS packed, round(100 - sum(length(text)) * 100 / sum(octet_length(encode(text))), 6) AS saved FROM documents")
def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _entry_sizes(spark, sf_dir).agg(F.count("*").alias("entries"), F.sum("size").alias("size"), F.sum("comp_size").alias("packed"))
    return t.withColumn("saved", F.round(100 - c("packed") * 100 / c("size"), 6))


GLOBS = ["*.html", "*/[a-m]*", "page?", "[^h]*", "*1*"]
_globs = [bytesx.glob_regex(g) for g in GLOBS]


@query("SELECT page_id, url FROM pages WHERE " + " OR ".join(f"regexp_matches({x}, {rules.sql_text(g)})" for g in _globs for x in ("url", "string_split(url, '/')[-1]")))
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where(bytesx.matches_any(c("url"), GLOBS)).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE NOT ends_with(url, '/')")
def skip_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where(~F.endswith("url", F.lit("/"))).select("page_id", "url")


@query("SELECT doc_id, string_split(source || '/' || doc_id::VARCHAR, '/')[-1] AS flat, 'out/' || source || '/' || doc_id::VARCHAR AS target FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def existing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", "source", c("doc_id").cast("string"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.element_at(F.split(name, "/"), -1).alias("flat"), F.concat_ws("/", F.lit("out"), name).alias("target"))
    return rows.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT page_id, (octet_length(encode(html)) <> length(html)) AS non_ascii, (octet_length(encode(html)) >= 30 AND hex(encode(html)[1:4]) = '504B0304') AS valid FROM pages")
def non_ascii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", (F.octet_length("html") != F.length("html")).alias("non_ascii"), zipformat.is_valid(bytesx.as_bytes(c("html"))).alias("valid"))


_MAGIC = ["", "504B03", "504B0304" + "00" * 26, "504B0304" + "00" * 25, "504B0506" + "00" * 18, "00" * 40]


@query("SELECT h, (length(h) // 2 >= 30 AND substr(h, 1, 8) = '504B0304') AS valid FROM (VALUES " + ", ".join(f"('{h}')" for h in _MAGIC) + ") v(h)")
def valid_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(h,) for h in _MAGIC], "h string")
    return rows.select("h", zipformat.is_valid(F.unhex("h")).alias("valid"))


@query("SELECT o_orderkey, (greatest(least(year(o_orderdate), 2107), 1980) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate) AS date_word, hour(o_orderdate) * 2048 + minute(o_orderdate) * 32 + second(o_orderdate) // 2 AS time_word, epoch(date_trunc('second', o_orderdate))::BIGINT // 2 * 2 AS back FROM orders")
def dos_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", c("o_orderdate").cast("timestamp").alias("t"))
    words = rows.select("o_orderkey", zipformat.dos_date_word(c("t")).cast("long").alias("date_word"), zipformat.dos_time_word(c("t")).cast("long").alias("time_word"))
    return words.withColumn("back", F.unix_timestamp(zipformat.dos_timestamp(c("date_word").cast("int"), c("time_word").cast("int"))))


@query("SELECT event_id, '5455' || '0500' || '01' || " + " || ".join(f"format('{{:02X}}', (epoch(date_trunc('second', ts))::BIGINT >> {8 * k}) & 255)" for k in range(4)) + " AS field, epoch(date_trunc('second', ts))::BIGINT AS back FROM events")
def extra_field_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.unix_timestamp(c("ts").cast("timestamp")).alias("u"))
    field = rows.select("event_id", F.concat(F.unhex(F.lit("5455050001")), bytesx.le_bytes(c("u"), 4)).alias("f"))
    return field.select("event_id", F.hex("f").alias("field"), bytesx.le_uint(c("f"), 5, 4).alias("back"))


@query("SELECT m::INT AS mode, CASE m & 61440 WHEN 16384 THEN 'dir' WHEN 40960 THEN 'link' ELSE 'file' END AS kind, (m & 511)::INT AS permissions, (m << 16)::BIGINT AS attributes FROM range(65536) t(m)")
def mode_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.range(65536).select(c("id").cast("int").alias("mode"))
    return m.select("mode", zipformat.mode_type(c("mode")).alias("kind"), c("mode").bitwiseAND(0o777).alias("permissions"), F.shiftleft(c("mode").cast("long"), 16).alias("attributes"))


# -- the benchmark grid

_facts_sql = "SELECT lang AS category, (length(text) // 1024)::INT AS size_kb, length(text)::BIGINT AS original, (length(text) // 2 + doc_id % 50)::BIGINT AS packed, (length(text) // 2 + 20)::BIGINT AS deflate_only FROM documents"
_gain_sql = f"round((deflate_only + {grid.CONTAINER} - packed) * 100 / (deflate_only + {grid.CONTAINER}), 6)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("long")
    rows = read(spark, sf_dir, "documents").select("doc_id", c("lang").alias("category"), F.floor(F.length("text") / 1024).cast("int").alias("size_kb"), F.length("text").cast("long").alias("original"), (half + c("doc_id") % 50).alias("packed"), (half + 20).alias("deflate_only"))
    return grid.derived(rows)


@query(f"WITH f AS ({_facts_sql}) SELECT category, size_kb, count(*) AS tests, count_if(packed <= deflate_only + {grid.CONTAINER}) AS wins, round(avg({_gain_sql}), 6) AS mean_gain FROM f GROUP BY GROUPING SETS ((), (category), (size_kb))")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.summary(_facts(spark, sf_dir))


@query(f"WITH f AS (SELECT doc_id, {_facts_sql[7:]}) SELECT doc_id, round(packed * 100 / greatest(original, 1), 6) AS ratio, round((deflate_only + {grid.CONTAINER}) * 100 / greatest(original, 1), 6) AS plain_ratio, {_gain_sql} AS gain, packed <= deflate_only + {grid.CONTAINER} AS wins FROM f")
def ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("doc_id", "ratio", "plain_ratio", "gain", "wins")


@query()
def bench_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.measure(grid.generate(spark), _vocabularies(spark, sf_dir))


_dimensions = {k: (v, "unknown" if k == "type" else "Unknown") for k, v in profile.LABELS.items()} | {f"wire_{k}": (v, "unknown") for k, v in zipformat.CODES.items()} | {"vocabulary": (list(zipformat.VOCAB_CODES), "unknown")}
_labels_known = [(k, i, x) for k, (names, _) in _dimensions.items() for i, x in enumerate(names)] + [("method", k, v) for k, v in choose.NAMES.items()]
_labels_beyond = [(k, len(names) + 7, other) for k, (names, other) in _dimensions.items()] + [("method", 99, "unknown")]


@query("SELECT kind, code::INT AS code, label FROM (VALUES " + ", ".join(f"('{k}', {i}, '{x}')" for k, i, x in _labels_known + _labels_beyond) + ") v(kind, code, label)")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(_labels_known, "kind string, code int, label string")
    asked = spark.createDataFrame([(k, i) for k, i, _ in _labels_known + _labels_beyond], "kind string, code int")
    other = F.when(c("kind").isin([k for k, (_, o) in _dimensions.items() if o == "Unknown"]), "Unknown").otherwise("unknown")
    return asked.join(F.broadcast(names), ["kind", "code"], "left").select("kind", "code", F.coalesce("label", other).alias("label"))


@query(f"WITH e AS ({_entries_sql}), f AS (SELECT archive_id, min(turn) AS turn FROM (SELECT conv_id AS archive_id, turn FROM conversations) GROUP BY archive_id) SELECT e.archive_id, name, size, mtime, mode FROM e JOIN f ON e.archive_id = f.archive_id AND e.ordinal = f.turn + 1")
def first_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _archives(spark, sf_dir, folder=False)
    return archives.first_entry(made, "archive_id").where("error is null").select("archive_id", "name", "size", F.unix_timestamp("mtime").alias("mtime"), "mode")


@query(f"SELECT archive_id, ordinal, name FROM ({_entries_sql}) WHERE regexp_matches(name, '^turns/[^/]*-user[.]txt$')")
def listing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _archives(spark, sf_dir)
    return archives.list_entries(made, "archive_id", patterns=["*-user.txt"]).select("archive_id", "ordinal", "name")


@query(f"SELECT archive_id, coalesce(name, '') AS name, line FROM (SELECT archive_id, name, format('{{:10d}}  {{}}', size, name) AS line FROM ({_entries_sql}) UNION ALL SELECT archive_id, NULL, format('{{:10d}}  {{}}', sum(size)::BIGINT, count(*)::VARCHAR || ' files') FROM ({_entries_sql}) GROUP BY archive_id)")
def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _archives(spark, sf_dir)
    listed = archives.listing(archives.list_entries(made, "archive_id"), "archive_id")
    return archives.printed(listed, "archive_id").select("archive_id", F.coalesce("name", F.lit("")).alias("name"), "line")


@query()
def listing_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _archives(spark, sf_dir)
    listed = archives.listing(archives.list_entries(made, "archive_id"), "archive_id", verbose=True)
    return archives.printed(listed, "archive_id", verbose=True)


@query("SELECT page_id, CASE WHEN ends_with(url, '.zip') THEN url ELSE url || '.zip' END AS file FROM pages UNION ALL SELECT page_id, url || '.zip' FROM pages")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(F.array("url", F.concat("url", F.lit(".zip")))).alias("name"))
    return rows.select("page_id", archives.archive_name(c("name")).alias("file"))


@query("SELECT size_kb, row_number() OVER (ORDER BY size_kb) - 1 AS place FROM (SELECT unnest([64, 2, 1024, 16, 8, 512, 4, 2048, 32, 128, 256]) AS size_kb)")
def sorted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("64,2, 1024,16,8,512,4,2048,32,128,256",)], "sizes string")
    return rows.select(F.posexplode(grid.parsed_sizes(c("sizes"))).alias("place", "size_kb")).select("size_kb", c("place").cast("long").alias("place"))


@query(f"SELECT doc_id, category, size_kb FROM (SELECT doc_id, {_facts_sql[7:]}) WHERE category = 'en' AND size_kb = 1")
def report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.filtered(_facts(spark, sf_dir), "en", 1).select("doc_id", "category", "size_kb")


@query(f"WITH f AS (SELECT doc_id, {_facts_sql[7:]}), g AS (SELECT *, {_gain_sql} AS gain FROM f) SELECT doc_id, printf('%.1f', gain) AS gain_pct, printf('%.1f', original / 1024) AS original_kb, printf('%.1f', packed / 1024) AS packed_kb, gain > 0 AS positive, lower(category) AS style FROM g")
def report_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.formatted(_facts(spark, sf_dir), "doc_id")


@query()
def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-ups of the whole grid, from the sizes that the codecs give."""
    return grid.summary(grid.measure(grid.generate(spark), _vocabularies(spark, sf_dir)))
