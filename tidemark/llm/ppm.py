"""Document scoring by prediction by partial matching (PPM) over bytes, beside a unigram word score.

The byte model is a trie of contexts of up to `ORDER` bytes with the counts of the bytes that follow them.
A byte that a context has not seen costs an escape, estimated from the context's distinct followers
(method C), and the next shorter context then predicts among the bytes not yet excluded; after the empty
context, all bytes left are equally likely. A text's code has a byte 0xFF, which UTF-8 never uses, before it
(as context) and after it (as its end). The model is trained beforehand.

The trie is shared tables, so it may grow with the corpus: for each order, the grams (a context and the byte after it) with
their counts, and the contexts with their totals. What a longer context has seen, the shorter ones that end it have seen too,
so exclusion takes no sets: a context has to know only how many followers it has and how often its next
shorter context saw those. No worker holds the trie: texts come in blocks of `BLOCK` bytes, a block asks for its
distinct grams, and the code lengths of just those come back to it.
Word counts: the `HOT` commonest words go to the workers; the rest are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

ORDER, EDGE = 4, 0xFF
#: Bytes of text that share one request to the trie; a longer text is a block of its own.
BLOCK = 16 << 20
#: Positions that are counted, or looked up, at once, and entries of a table that is indexed rather than searched.
STEP, WALK, DENSE = 1 << 20, 1 << 16, 1 << 22
#: Commonest words that every worker holds.
HOT = 200_000
#: Distinct words that a task counts before it passes them on.
HELD = 400_000

BLOCKS = "kind int, block long, key long, doc_id long, held_out boolean, text string, gram long, token binary, n long"
TEXTS, GRAMS, TOKENS = range(3)
SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_score double, score double, rare array<struct<token:binary,k:long>>"


def lower_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with `ORDER` edge bytes before each and one after it, and where each begins, edges included."""
    pad = bytes([EDGE]) * ORDER
    flat = np.frombuffer(b"".join([pad + t + pad[:1] for t in texts]), np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    return flat, np.cumsum(sizes) - sizes


def stretches(flat: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """All positions that have a whole context, some at a time."""
    for at in range(ORDER, len(flat), step):
        yield at, min(at + step, len(flat))


def alphabet(used: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each byte of used, and how many there are."""
    slot = np.zeros(256, np.int32)
    slot[used] = np.arange(len(used))
    return slot, len(used)


def ranked(codes: np.ndarray, size: int, dense: int) -> tuple[np.ndarray, int]:
    """Codes below size, numbered anew without holes."""
    if size > dense:
        found, at = np.unique(codes, return_inverse=True)
        return at.astype(np.int32), len(found)
    seen = np.zeros(size, bool)
    seen[codes] = True
    found = np.nonzero(seen)[0]
    number = np.empty(size, np.int32)
    number[found] = np.arange(len(found))
    return number[codes], len(found)


def extended(codes: np.ndarray, size: int, m: int, digit: np.ndarray) -> np.ndarray:
    """codes * m + digit, in 64 bits where 32 don't do."""
    if size * m >= 1 << 31:
        codes = codes.astype(np.int64)
    out = codes * codes.dtype.type(m)
    out += digit
    return out


def grams(texts: list[bytes], dense: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, count) of every byte with the `ORDER` before it, some positions at a time."""
    flat, starts = joined(texts)
    for s, e in stretches(flat, STEP):
        x = flat[s - ORDER : e]
        slot, m = alphabet(np.nonzero(np.bincount(x, minlength=256))[0])
        y = slot[x]
        codes, size = y[: e - s], m
        for k in range(1, ORDER + 1):
            if size * m > dense:
                codes, size = ranked(codes, size, dense)
            codes, size = extended(codes, size, m, y[k : k + e - s]), size * m
        codes, size = ranked(codes, size, dense)
        i, j = np.searchsorted(starts, [s - ORDER, e])
        leading = (starts[i:j, None] + np.arange(ORDER) - s).reshape(-1)  # the context before a text isn't part of its code
        codes[leading[(leading >= 0) & (leading < e - s)]] = size
        place = np.full(size + 1, -1, np.int32)
        place[codes] = np.arange(e - s, dtype=np.int32)  # some place of each gram
        real = place[:size] >= 0
        found = np.zeros(int(real.sum()), np.int64)
        for k in range(ORDER + 1):
            found = (found << 8) | x[place[:size][real] + k]
        yield found, np.bincount(codes, minlength=size + 1)[:size][real]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same gram added."""
    found, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


class Lookup:
    """The code lengths of a block's grams, as a trie that is walked byte by byte."""

    def __init__(self, found: np.ndarray, values: np.ndarray, dense: int = DENSE):
        order = np.argsort(found)
        found, self.values = found[order], values[order]
        used = np.unique(np.concatenate([np.unique((found >> (8 * k)) & 255) for k in range(ORDER + 1)]))
        self.slot, self.m = alphabet(used)
        above = np.unique(found >> (8 * ORDER))
        self.first = np.zeros(256, np.int32)
        self.first[above] = np.arange(len(above))
        self.steps: list[tuple[bool, int, np.ndarray]] = []  # is it indexed, how many nodes are above, next nodes by code
        for k in range(ORDER - 1, -1, -1):
            here = np.unique(found >> (8 * k))
            codes = np.searchsorted(above, here >> 8) * self.m + self.slot[here & 255]
            direct = len(above) * self.m <= dense
            if direct:
                table = np.zeros(len(above) * self.m, np.int32)
                table[codes] = np.arange(len(here))
            self.steps.append((direct, len(above), table if direct else codes))  # codes ascend, as here does
            above = here

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The sum over each text and its end."""
        flat, starts = joined(texts)
        out = np.zeros(len(texts))
        for s, e in stretches(flat, WALK):
            x = flat[s - ORDER : e]
            y, at = self.slot[x], self.first[x[: e - s]]
            for k, (direct, above, table) in enumerate(self.steps, 1):
                codes = extended(at, above, self.m, y[k : k + e - s])
                at = table[codes] if direct else np.minimum(np.searchsorted(table, codes), len(table) - 1).astype(np.int32)
            part = self.values[at].astype(np.float64)
            i, j = np.searchsorted(starts, [s - ORDER, e])
            leading = (starts[i:j, None] + np.arange(ORDER) - s).reshape(-1)
            part[leading[(leading >= 0) & (leading < e - s)]] = 0.0
            i, j = np.searchsorted(starts, [s, e - 1], side="right") - 1
            out[i : j + 1] += np.add.reduceat(part, np.maximum(starts[i : j + 1] - s, 0))
        return out


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """A shared table of docs(doc_id, held_out, text) in blocks, the distinct grams of each block with their counts in training,
    and the training texts' words (the end: an empty token), partly counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
        names = [c.split()[0] for c in BLOCKS.split(", ")]

        def rows(kind: int, size: int, **given) -> pa.RecordBatch:
            given["kind"] = pa.array(np.full(size, kind, np.int32))
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, t)) for c, t in zip(names, types, strict=True)], names=names)

        def all_grams() -> pa.RecordBatch:
            found, n = summed(parts)
            return rows(GRAMS, len(found), block=pa.array(np.full(len(found), block)), gram=pa.array(found), n=pa.array(n))

        def all_words() -> pa.RecordBatch:
            return rows(TOKENS, len(words), token=pa.array(list(words), pa.binary()), n=pa.array(list(words.values()), pa.int64()))

        words: Counter = Counter()
        parts: list = []
        block, held = None, 0
        for batch in batches:
            key, doc_id, held_out, text = batch.columns
            if block is None:
                block = key[0].as_py()
            yield rows(TEXTS, len(key), block=pa.array(np.full(len(key), block)), key=key, doc_id=doc_id, held_out=held_out, text=text)
            texts = [lower_bytes(t) for t in text.to_pylist()]
            training = ~np.array(held_out.to_pylist(), bool)
            for t, own in zip(texts, training, strict=True):
                if own:
                    words.update(t.split())
                    words[b""] += 1
            for counted in (True, False):
                for found, n in grams([t for t, own in zip(texts, training, strict=True) if own == counted]):
                    parts.append((found, n * counted))
                    if len(parts) > 8:
                        parts = [summed(parts)]
            held += sum(map(len, texts))
            if held > block_bytes:
                yield all_grams()
                parts, block, held = [], None, 0
            if len(words) > HELD:
                yield all_words()
                words = Counter()
        if parts:
            yield all_grams()
        if words:
            yield all_words()

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return scratch.keep(keyed.mapInArrow(run, BLOCKS), "blocks", compression="zstd")


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; of a null key: of the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def trie(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """From counts(gram, c) of the longest grams: for each order from 0 on, grams(gram, c) and contexts(context, total, kinds, below).

    `below` is how often the next shorter context saw the followers of this one.
    """
    levels = [counts.where("c > 0").select("gram", "c")]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1)
        levels.insert(0, scratch.keep(levels[0].groupBy(shorter.alias("gram")).agg(F.sum("c").alias("c")), f"grams-{k}"))
    contexts = []
    for k, level in enumerate(levels):
        own = level.withColumn("context", F.shiftright("gram", 8))
        if k:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * k)) - 1))
            own = own.join(levels[k - 1].select(F.col("gram").alias("suffix"), F.col("c").alias("less")), "suffix")
        else:
            own = own.withColumn("less", F.lit(0).cast("long"))
        found = own.groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.sum("less").alias("below"))
        contexts.append(scratch.keep(found, f"contexts-{k}"))
    return levels, contexts


def code_lengths(counts: DataFrame) -> DataFrame:
    """(gram, p): log10 of the probability of each gram's last byte after its others, for all of counts(gram, c), c = 0 included."""
    levels, contexts = trie(counts)
    escape = lambda kinds, known: F.when(F.col(kinds) == 256, 0).otherwise(F.col(kinds) - known)
    none = F.lit(0).cast("long")
    top = counts.withColumn("context", F.shiftright("gram", 8)).join(contexts[ORDER], "context", "left")
    top = top.withColumn("out", escape("kinds", none)).select(
        "gram", "c", F.log10(F.when(F.col("c") > 0, F.col("c")).otherwise(F.col("out")) / (F.col("total") + F.col("out"))).alias("p"),
        F.coalesce("below", none).alias("gone"), F.coalesce("kinds", none).alias("known"),
    )
    top = scratch.keep(top.withColumn("p", F.coalesce("p", F.lit(0.0))), "longest")
    done = [top.where("c > 0").select("gram", "p")]
    left = top.where("c = 0").drop("c")  # each of these goes on to shorter contexts
    for k in range(ORDER - 1, -1, -1):
        left = left.withColumn("own", F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1)).withColumn("context", F.shiftright("own", 8))
        left = left.join(levels[k].select(F.col("gram").alias("own"), "c"), "own", "left").join(contexts[k], "context", "left")
        left = left.withColumn("out", F.coalesce(escape("kinds", F.col("known")), none)).withColumn("rest", F.coalesce(F.col("total") - F.col("gone"), none))
        share = F.when(F.col("c").isNotNull(), F.col("c")).when(F.col("rest") > 0, F.col("out")) / F.when(F.col("rest") > 0, F.col("rest") + F.col("out"))
        left = scratch.keep(left.select("gram", (F.col("p") + F.coalesce(F.log10(share), F.lit(0.0))).alias("p"), F.col("c").isNotNull().alias("found"), F.coalesce("below", none).alias("gone"), F.coalesce("kinds", none).alias("known")), f"escaped-{k}")
        done.append(left.where("found").select("gram", "p"))
        left = left.where("not found").drop("found")
    done.append(left.select("gram", F.col("p") - F.log10(256 - F.col("known"))))
    for part in done[1:]:
        done[0] = done[0].unionByName(part.toDF("gram", "p"))
    return done[0]


def hot_count(words: DataFrame, hot: int) -> int:
    """A count that at most `hot` words reach: the histogram of counts, in steps of a sixteenth of a doubling, has some
    hundred rows however many words there are, so nothing is sorted and no task sees them all."""
    step = F.floor(F.log2("c") * 16).cast("int")
    taken = 0
    least = None
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        taken += row["n"]
        if taken > hot:
            break
        least = row["c"]
    return least if least is not None else 1 << 62


def score(docs: DataFrame, hot: int = HOT, block_bytes: int = BLOCK) -> DataFrame:
    """docs(doc_id, held_out, text) with the two scores of every whole text, as op8's contract names them, trained on those not held out."""
    spark = docs.sparkSession
    blocks = in_blocks(docs, block_bytes)
    words = scratch.keep(blocks.where(f"kind = {TOKENS}").groupBy("token").agg(F.sum("n").alias("c")), "words")
    asked = blocks.where(f"kind = {GRAMS}").select("block", "gram", "n")
    counts = scratch.keep(asked.groupBy("gram").agg(F.sum("n").alias("c")), "grams")
    answers = asked.select("block", "gram").join(code_lengths(counts).select("gram", F.col("p").cast("float").alias("p")), "gram").select(F.col("block").alias("to"), "gram", "p")

    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = words.where(F.col("c") >= hot_count(words, hot)).toArrow()  # at most `hot` rows
    held = spark.sparkContext.broadcast(dict(zip(common["token"].to_pylist(), common["c"].to_pylist(), strict=True)))
    below = n + 0.5 * (v + 1)
    made: dict = {}

    def finish(texts_of: pa.Table, answer: pa.Table) -> pa.Table:
        if not made:
            made["log"] = {w: float(np.log10((c + 0.5) / below)) for w, c in held.value.items()}
        log = made["log"]
        lookup = Lookup(answer["gram"].to_numpy(), answer["p"].to_numpy())
        out = []
        for batch in texts_of.to_batches(max_chunksize=256):
            texts = [lower_bytes(t) for t in batch["text"].to_pylist()]
            totals, n_tokens, n_hot, rest, ends, times = [], [], [], [], [0], []
            for t in texts:
                found = Counter(t.split())
                found[b""] = 1
                total, hits, size = 0.0, 0, 0
                for w, k in found.items():
                    size += k
                    if (x := log.get(w)) is None:
                        rest.append(w)
                        times.append(k)
                    else:
                        total += k * x
                        hits += k
                totals.append(total)
                n_tokens.append(size)
                n_hot.append(hits)
                ends.append(len(rest))
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], names=["token", "k"]))
            columns = [batch["key"], batch["doc_id"], batch["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(totals, pa.float64()), pa.array(lookup.scores(texts)), rare]
            out.append(pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "held_out", "n_tokens", "n_hot", "hot_score", "score", "rare"]))
        return pa.Table.from_batches(out)

    texts = blocks.where(f"kind = {TEXTS}").select("block", "key", "doc_id", "held_out", "text")
    own = scratch.keep(texts.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(finish, SCORED), "scored")
    scratch.drop(blocks, counts)
    rare = own.select("key", F.explode("rare").alias("r")).select("key", "r.token", "r.k").join(words, "token", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("key").agg(F.sum(F.col("k") * F.log10((c + 0.5) / F.lit(below))).alias("rare_score"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("n_rare"))
    return own.drop("rare").join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
    )


def score_corpus(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Scores every row of docs(doc_id, text) after training on the rows whose crc32(doc_id) mod folds is not `held`.

    A null text is empty: its only token is the end. Repeated rows are scored, and trained on, each. Without
    training rows all counts are zero and the byte model is uniform. Other columns are not read.
    """
    scratch.long_rows(docs.sparkSession)
    return score(docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "text"))
