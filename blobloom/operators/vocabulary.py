"""Token vocabularies: numbering, lookup, greedy tokenisation, training, and variable-length integers.

A vocabulary is a DataFrame (token BINARY, rank INT). Greedy longest match by a trie
over bytes runs in an Arrow UDF; its compiled trie is built once for each worker. A
vocabulary is a model of bounded size: loading one beyond ``MAX_TOKENS`` is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytesx import latin1

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

MAX_TOKENS = 200_000
#: Bytes of content up to which training runs on the driver: hundreds of passes over so little would be nothing but overhead.
LOCAL_BYTES = 256 << 10
#: Characters whose pairs are counted at a time.
PIECE = 1 << 20


def renumber(vocab: DataFrame) -> DataFrame:
    """(token, id): ids from 0 in the order of rank, ties by token."""
    return vocab.select("token", (F.row_number().over(W.orderBy("rank", "token")) - 1).alias("id"))


def basic(spark: SparkSession) -> DataFrame:
    """One token for each byte."""
    return spark.range(256).select(F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").cast("int").alias("rank"))


def load_tiktoken(lines: DataFrame) -> DataFrame:
    """(token, rank) of a DataFrame of lines `base64 rank`, in order; lines without a blank are skipped, of equal tokens the
    last line wins.

    A malformed token or rank (a third field makes it one) fails the query."""
    at = F.instr("value", " ")
    rank = F.when(F.substring("value", at + 1, F.length("value")).rlike("^[+-]?[0-9]+$"), F.substring("value", at + 1, F.length("value")).cast("int")).otherwise(F.raise_error(F.concat(F.lit("invalid rank: "), F.col("value"))).cast("int"))
    rows = lines.where(at > 0).select(F.unbase64(F.substring("value", F.lit(1), at - 1)).alias("token"), rank.alias("rank"), F.monotonically_increasing_id().alias("line"))
    return rows.groupBy("token").agg(F.max_by("rank", "line").alias("rank"))


def stats(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("size"), F.max(F.octet_length("token")).alias("max_len"))


def _automaton(root: dict, tokens: list[bytes]):
    """An automaton of the tokens, if the library for it is there and every byte is a token."""
    if ahocorasick is None or any(None not in root.get(b, ()) for b in range(256)):
        return None
    out = ahocorasick.Automaton()
    for i, t in enumerate(tokens):
        if t:
            out.add_word(t.decode("latin-1"), i)
    out.make_automaton()
    return out


class Trie:
    """Nested dicts by byte; the token's id under None."""

    def __init__(self, tokens: Iterable[bytes]):
        tokens = list(tokens)
        self.root: dict = {}
        for i, t in enumerate(tokens):
            node = self.root
            for b in t:
                node = node.setdefault(b, {})
            node[None] = i
        self.fast = _automaton(self.root, tokens)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, id) of the longest token that starts at a position; (0, -1) if there is none."""
        node, best, i, n = self.root, (0, -1), at, len(data)
        while i < n and (node := node.get(data[i])) is not None:
            i += 1
            if None in node:
                best = (i - at, node[None])
        return best

    def encode(self, data: bytes) -> list[int]:
        """Greedy longest match from left to right; a byte that no token covers gives its own value."""
        if self.fast is not None:
            # The leftmost longest matches; as every byte is a token, each begins where the last one ended.
            return [i for _, i in self.fast.iter_long(data.decode("latin-1"))]
        out, at = [], 0
        while at < len(data):
            length, i = self.longest(data, at)
            out.append(i if length else data[at])
            at += length or 1
        return out


_tries: dict[tuple[bytes, ...], Trie] = {}


def trie_of(tokens: tuple[bytes, ...]) -> Trie:
    if tokens not in _tries:
        if len(_tries) > 8:
            _tries.clear()
        _tries[tokens] = Trie(tokens)
    return _tries[tokens]


def collected(vocab: DataFrame) -> tuple[bytes, ...]:
    """The tokens by id; an error beyond MAX_TOKENS, so what is broadcast is bounded."""
    rows = renumber(vocab).orderBy("id").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"a vocabulary holds at most {MAX_TOKENS} tokens")
    return tuple(bytes(r["token"]) for r in rows)


def encoder(tokens: tuple[bytes, ...]):
    """An Arrow UDF from BINARY to token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(content: pa.Array) -> pa.Array:
        t = trie_of(tokens)
        return pa.array([t.encode(x.as_py()) if x.is_valid else None for x in content], pa.list_(pa.int32()))

    return encode


def register(spark: SparkSession, tokens: tuple[bytes, ...], name: str = "bpe_tokens") -> None:
    """A table function: bpe_tokens(content) gives (place, id, token) of greedy longest match."""

    @F.udtf(returnType="place int, id int, token binary")
    class BpeTokens:
        def eval(self, content: bytes):
            for k, i in enumerate(trie_of(tokens).encode(bytes(content or b""))):
                yield k, i, tokens[i]

    spark.udtf.register(name, BpeTokens)


def encode_regex(l1: Column, tokens: tuple[bytes, ...], single: bool = True) -> Column:
    """The pieces that greedy longest match cuts a Latin-1 view into, as built-in regex extraction; for small vocabularies.
    single: also the bytes that no token covers.

    The tokens are one nested pattern by their bytes, the longer way first, so a place is looked at once, not once a token."""
    root: dict = {}
    for t in tokens:
        node = root
        for b in t:
            node = node.setdefault(b, {})
        if t:
            node[None] = {}

    def pattern(node: dict) -> str:
        ways = "|".join(f"\\x{b:02X}{pattern(x)}" for b, x in sorted((b, x) for b, x in node.items() if b is not None))
        return f"(?:{ways}){'?' if None in node else ''}" if ways else ""

    ways = pattern(root) or "(?!)"
    return F.regexp_extract_all(l1, F.lit(f"(?s){ways}|." if single else f"(?s){ways}"), 0)


def decode(encoded: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, content) of rows (key, ids); unknown ids are dropped, rows without known ids are empty."""
    exploded = encoded.select(F.col(key).alias("__key"), F.posexplode_outer("ids").alias("__pos", "__id"))
    names = renumber(vocab).select(F.col("id").alias("__id"), F.hex("token").alias("__hex"))
    part = F.when(F.col("__hex").isNotNull(), F.struct("__pos", "__hex"))
    joined = exploded.join(names, "__id", "left").groupBy("__key").agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    return joined.select(F.col("__key").alias(key), F.unhex(F.array_join(F.transform("__parts", lambda p: p["__hex"]), "")).alias("content"))


def pair_counts(symbols: DataFrame, text: str = "z") -> DataFrame:
    """(pair, n): how often two characters stand next to each other, overlapping ones included.

    Each task counts its own pairs first, so no more than one row of a pair comes from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        held, chars = [], 0
        bytewise = np.zeros(1 << 16, np.int64)

        def count() -> None:
            nonlocal held, chars, size
            flat = np.concatenate(held)
            ok = np.ones(len(flat) - 1, bool)
            ok[np.cumsum([len(t) for t in held])[:-1] - 1] = False
            held, chars = [], 0
            if flat.max() < 256:
                np.add(bytewise, np.bincount((flat[:-1] << np.uint16(8) | flat[1:])[ok], minlength=1 << 16), out=bytewise)
                return
            flat = flat.astype(np.uint32)
            k, n = np.unique((flat[:-1] << np.uint32(16) | flat[1:])[ok], return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            uniq, of = np.unique(np.concatenate(keys), return_inverse=True)
            return uniq, np.bincount(of, np.concatenate(counts), len(uniq)).astype(np.int64)

        for b in batches:
            for t in (x.as_py() for x in b.column(0)):
                # A piece ends with the character that the next one begins with, so every pair is in one piece.
                for at in range(0, len(t or "") - 1, PIECE):
                    x = np.frombuffer(t[at : at + PIECE + 1].encode("utf-16-le"), np.uint16)
                    held.append(x)
                    chars += len(x)
                    if chars > PIECE:
                        count()
                        if size > 1 << 22:
                            k, n = summed()
                            keys, counts, size = [k], [n], len(k)
        if held:
            count()
        at = np.flatnonzero(bytewise)
        keys.append((at >> 8 << 16 | at & 255).astype(np.uint32))
        counts.append(bytewise[at])
        k, n = summed()
        if len(k):
            yield pa.record_batch([pa.array([chr(p >> 16) + chr(p & 0xFFFF) for p in k.tolist()], pa.string()), pa.array(n, pa.int64())], ["pair", "n"])

    return symbols.select(text).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def merge(symbols: DataFrame, pair: str, new: int, text: str = "z") -> DataFrame:
    """Replace a pair by the character of a new id, left to right, not overlapping."""
    return symbols.withColumn(text, F.replace(F.col(text), F.lit(pair), F.lit(chr(new))))


def _settled(top: list[tuple[str, int]], complete: bool) -> list[str]:
    """Of the most frequent pairs in order, those that one merge after the other will take, whatever the merges before
    them make: a merge of (a, b) leaves alone the counts of pairs without a and b, and every pair that it makes takes its
    places from one with a or b, so it is no more frequent than that. complete: there are no other pairs."""
    out: list[str] = []
    used: set[str] = set()
    for k, (pair, n) in enumerate(top):
        if n < 2 or used & set(pair):
            break
        # A new pair can be as frequent as this one only if a pair with a merged symbol is; ties go by symbols.
        rivals = [m for p, m in top[k + 1 :] if used & set(p)]
        if out and (max(rivals, default=0) >= n or not complete and top[-1][1] >= n):
            break
        out.append(pair)
        if pair[0] == pair[1]:  # in a run of it, a new pair takes its places from the pair itself
            break
        used |= set(pair)
    return out


def train(docs: DataFrame, content: Column, merges: int, cut_every: int = 8, ahead: int = 256, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(token, rank): the 256 bytes and one token for each merge of the most frequent pair (ties: the lesser pair).

    Pairs never cross documents. Ends when no pair occurs twice. Ids are characters, so at most 55,000 of them. One count
    of the pairs serves as many merges as it settles, looking at the first ``ahead`` pairs. Lineage is cut with
    checkpoint() every few merges, in the session's checkpoint folder. Content of up to ``local_bytes``, which is checked, is
    trained on by the driver, with the same result."""
    spark = docs.sparkSession
    if merges > 55_000 - 256:
        raise ValueError("too many merges")
    if (docs.agg(F.sum(F.octet_length(content))).first()[0] or 0) <= local_bytes:
        blobs = [bytes(r[0]) for r in docs.select(content).collect() if r[0] is not None]
        return spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(train_local(blobs, merges))], "token binary, rank int")
    z = docs.select(latin1(content).alias("z")).where("z is not null")
    tokens = [bytes([i]) for i in range(256)]
    cut = 256
    while len(tokens) < 256 + merges:
        top = [(r["pair"], r["n"]) for r in pair_counts(z).orderBy(F.desc("n"), "pair").limit(ahead).collect()]
        taken = _settled(top, len(top) < ahead)[: 256 + merges - len(tokens)]
        if not taken:
            break
        for pair in taken:
            z = merge(z, pair, len(tokens))
            tokens.append(tokens[ord(pair[0])] + tokens[ord(pair[1])])
        if len(tokens) - cut >= cut_every and spark.sparkContext.getCheckpointDir():
            z, cut = z.checkpoint(), len(tokens)
    return spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(tokens)], "token binary, rank int")


def train_local(blobs: Iterable[bytes], merges: int) -> tuple[bytes, ...]:
    """The tokens that train() finds, of a bounded sample on the driver: all counts anew for each merge, as arrays."""
    x = np.concatenate([np.zeros(0, np.int64), *(np.append(np.frombuffer(b, np.uint8).astype(np.int64), -1) for b in blobs)])
    tokens = [bytes([i]) for i in range(256)]
    while len(tokens) < 256 + merges and len(x) > 1:
        ok = (x[:-1] >= 0) & (x[1:] >= 0)
        # Pairs sort by their first symbol, then by their second: the first of the largest counts is the least pair.
        pair, n = np.unique((x[:-1] << 20 | x[1:])[ok], return_counts=True)
        if not len(n) or n.max() < 2:
            break
        a, b = divmod(int(pair[n.argmax()]), 1 << 20)
        at = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
        if a == b and len(at):
            # Of a run, every second place.
            new = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            rank = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            at = at[rank % 2 == 0]
        x[at] = len(tokens)
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x = x[keep]
        tokens.append(tokens[a] + tokens[b])
    return tuple(tokens)


def varint_size(ids: Column) -> Column:
    """Bytes of the ids as 7-bit variable-length integers."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + F.when(x < 128, 1).when(x < 16384, 2).when(x < 2097152, 3).when(x < 268435456, 4).otherwise(5))


def varint_bytes(ids: Column) -> Column:
    """The ids as 7-bit variable-length integers, low group first, the top bit set where more follow."""
    byte = lambda x, k, more: F.lpad(F.hex(F.shiftrightunsigned(x, 7 * k).bitwiseAND(127).bitwiseOR(128 if more else 0)), 2, "0")

    def one(x: Column) -> Column:
        out = F.concat(*(byte(x, k, k < 4) for k in range(5)))
        for n in range(4, 0, -1):
            out = F.when(x < 1 << (7 * n), F.concat(*(byte(x, k, k < n - 1) for k in range(n)))).otherwise(out)
        return out

    return F.unhex(F.array_join(F.transform(ids, one), ""))


def escape_literal(l1: Column) -> Column:
    """A Latin-1 view as the inside of a quoted source literal."""
    chars = F.filter(F.split(l1, ""), lambda c: c != "")
    esc = lambda c: F.when(c == "\\", "\\\\").when(c == '"', '\\"').when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c.between(" ", "~"), c).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0"))))
    return F.array_join(F.transform(chars, esc), "")


def literals(vocab: DataFrame) -> DataFrame:
    """(rank, line): a vocabulary's tokens by rank as lines of a map literal of a source file, `"token": rank,`."""
    return vocab.select("rank", F.concat(F.lit('"'), escape_literal(latin1(F.col("token"))), F.lit('": '), F.col("rank").cast("string"), F.lit(",")).alias("line"))


def write_source(vocab: DataFrame, path: str, name: str = "tokens") -> None:
    """The whole literal, as one text file, in order of rank. A vocabulary is bounded, so it fits a task."""
    spark = vocab.sparkSession
    size = vocab.count()
    if size > MAX_TOKENS:
        raise ValueError(f"a vocabulary holds at most {MAX_TOKENS} tokens")
    frame = spark.createDataFrame([(-1 << 40, f"{name} = {{"), (1 << 40, "}")], "rank long, line string")
    lines = literals(vocab).select(F.col("rank").cast("long").alias("rank"), F.concat(F.lit("    "), "line").alias("line")).unionByName(frame)
    lines.coalesce(1).sortWithinPartitions("rank", "line").select("line").write.mode("overwrite").text(path)
