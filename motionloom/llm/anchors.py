"""Where texts can share a window: the few positions that every two equal windows have in common.

In each window of ``w`` tokens the ``k``-gram with the least hash is its anchor. Equal windows have the same anchor
at the same place, so only occurrences of one anchor need to be compared. An anchor's surroundings (its context:
all windows that hold it) settle most of them: a context seen before repeats all its windows, an anchor with one
context repeats none. The rest, anchors with several contexts, are compared by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .common import row_key
from .tokens import BYTE_CODE, Sums, find_words, joined, mix, shards, word_codes

ANCHOR_SCHEMA = "route long, gram long, context long, row long, doc long, pos int, low int, high int, known boolean"
FOUND_SCHEMA = "row long, gram long, pos int, low int, high int, places array<int>, known boolean"
_NONE = np.uint32(0xFFFFFFFF)


def sliding(f, x: np.ndarray, width: int, ahead: bool) -> np.ndarray:
    """``f`` (minimum or maximum) over ``width`` neighbours ahead of (or behind) each place, as far as there are."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step >= len(out):
            step = len(out)
        new = out.copy()
        if ahead:
            f(out[:-step] if step else out, out[step:], out=new[: len(out) - step])
        else:
            f(out[step:], out[: len(out) - step], out=new[step:])
        out, have = new, have + step
        if step == len(out):
            break
    return out


def pick(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of sequences lying at [begin, end) in ``codes``: their place, their hash, and the index of their sequence."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < window:
        return none
    sums = Sums(codes)
    gram = sums.grams(k)
    order = (gram >> np.uint64(32)).astype(np.uint32)
    owner = np.searchsorted(end, np.arange(len(order)), side="right")
    owner = np.minimum(owner, len(end) - 1)
    at = np.arange(len(order))
    out = (at < begin[owner]) | (at + k > end[owner]) | (end[owner] - begin[owner] < window)
    order[out] = _NONE
    least = sliding(np.minimum, order, window - k + 1, True)
    # the windows that hold a place end at the last one that lies in the array
    last = len(order) - (window - k)
    least[max(last, 0) :] = 0
    chosen = (sliding(np.maximum, least, window - k + 1, False) == order) & ~out
    place = np.flatnonzero(chosen)
    return place, gram[place], owner[place]


def codes_of(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the tokens (bytes or words) of all texts, each text's [begin, end) among them, the bytes, and the tokens' starts and ends."""
    data, begin, end = joined(texts)
    if unit == "byte":
        return BYTE_CODE[data], begin, end, data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, stop, upto = find_words(data, end)
    return word_codes(data, start, stop), np.concatenate(([0], upto[:-1])).astype(np.int64), upto, data, start, stop


def contexts(codes: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return Sums(codes).of(low, high) ^ mix(((place - low) << 20 | (high - place)).astype(np.uint64))


def first_of(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by anchor, context, document and place; in it, the start of each anchor's and of each context's rows."""
    order = np.lexsort((pos, doc, context, gram))
    gram, context = gram[order], context[order]
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))[: len(gram)]
    return order, new_gram, new_gram | np.concatenate(([True], context[1:] != context[:-1]))[: len(gram)]


def repeats(new: np.ndarray, doc: np.ndarray, pos: np.ndarray, same_doc: bool) -> np.ndarray:
    """Whether a context was there before: at any earlier place, or (not ``same_doc``) in an earlier document. Repeated rows are one."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc > doc[first]) | ((pos > pos[first]) & same_doc)


def _anchors(unit: str, window: int, k: int, same_doc: bool):
    """Anchor rows of each shard. What the shard itself shows to be repeated goes a way of its own (by row), so that
    a passage in a third of all texts sends one row a shard to its anchors' partitions, not one a text."""

    def run(batches):
        for rows, texts in shards(batches):
            codes, begin, end, *_ = codes_of(texts, unit)
            place, gram, owner = pick(codes, begin, end, window, k)
            low, high = np.maximum(place - (window - k), begin[owner]), np.minimum(place + window, end[owner])
            context = contexts(codes, place, low, high)
            doc, row = rows["doc"].to_numpy()[owner], rows["row"].to_numpy()[owner]
            place, low, high = place - begin[owner], low - begin[owner], high - begin[owner]
            gram, context = gram.view(np.int64), context.view(np.int64)
            order, _, new = first_of(gram, context, doc, place)
            gram, context, row, doc, place, low, high = (x[order] for x in (gram, context, row, doc, place, low, high))
            known = repeats(new, doc, place, same_doc)
            route = np.where(known, row, gram)
            cols = [route, gram, context, row, doc, *(x.astype(np.int32) for x in (place, low, high)), known]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["route", "gram", "context", "row", "doc", "pos", "low", "high", "known"])

    return run


def _judge(same_doc: bool):
    """Within one partition of anchors: what is known of each occurrence. Equal contexts in one text are one row."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        cols = [t[i].to_numpy() for i in range(1, 9)]
        names = ["row", "gram", "pos", "low", "high", "places", "known"]

        def out(row, gram, pos, low, high, places, known):
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(gram), pa.array(pos), pa.array(low), pa.array(high), places, pa.array(known)], names)

        def alone(pos):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32)), pa.array(pos))

        settled = cols[7]
        gram, _, row, _, pos, low, high, _ = (c[settled] for c in cols)
        yield out(row, gram, pos, low, high, alone(pos), np.ones(len(row), bool))
        gram, context, row, doc, pos, low, high, _ = (c[~settled] for c in cols)
        order, new_gram, new = first_of(gram, context, doc, pos)
        gram, row, doc, pos, low, high = (x[order] for x in (gram, row, doc, pos, low, high))
        known = repeats(new, doc, pos, same_doc)
        yield out(row[known], gram[known], pos[known], low[known], high[known], alone(pos[known]), np.ones(known.sum(), bool))
        group = np.cumsum(new_gram) - 1
        open_ = (np.bincount(group, new)[group] > 1) & ~known
        gram, row, pos, low, high, new = (x[open_] for x in (gram, row, pos, low, high, new))
        unit = np.flatnonzero(new | np.concatenate(([True], row[1:] != row[:-1]))[: len(row)])
        places = pa.ListArray.from_arrays(pa.array(np.append(unit, len(row)).astype(np.int32)), pa.array(pos))
        yield out(row[unit], gram[unit], pos[unit], low[unit], high[unit], places, np.zeros(len(unit), bool))

    return run


def rank(doc_id: Column) -> Column:
    """The order of documents as a number: null first."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, doc, text)."""
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", rank(F.col("doc_id")).alias("doc"), "text")


def shared_places(docs: DataFrame, unit: str, window: int, k: int, same_doc: bool) -> DataFrame:
    """FOUND rows of ``keyed`` documents: anchors whose windows are all known to occur earlier (``known``), and
    those with several contexts, which need their texts compared. Anchors that occur once are gone.
    """
    found = docs.select("row", "doc", "text").mapInArrow(_anchors(unit, window, k, same_doc), ANCHOR_SCHEMA)
    return found.repartition("route").mapInArrow(_judge(same_doc), FOUND_SCHEMA)


def _bodies(unit: str):
    """The text of the contexts that need comparing, from their first token to their last."""

    def run(batches):
        for rows, texts in shards(batches):
            data, begin, end = joined(texts)
            if unit == "word":
                start, stop, upto = find_words(data, end)
                begin = np.concatenate(([0], upto[:-1])).astype(np.int64)
            items = rows["items"].combine_chunks()
            n = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), n)
            flat = items.flatten()
            low, high = (flat.field(x).to_numpy().astype(np.int64) for x in ("low", "high"))
            low, high = low + begin[owner], high + begin[owner]
            if unit == "word":
                low, high = start[low], stop[high - 1]
            raw = memoryview(data)
            body = [raw[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            cols = [flat.field("gram"), rows["row"].combine_chunks().take(pa.array(owner)), rows["doc"].combine_chunks().take(pa.array(owner)), *(flat.field(x) for x in ("pos", "low", "high", "places")), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["gram", "row", "doc", "pos", "low", "high", "places", "body"])

    return run


BODY_SCHEMA = "gram long, row long, doc long, pos int, low int, high int, places array<int>, body binary"
SPAN_SCHEMA = "row long, low int, high int"


def repeated_spans(docs: DataFrame, unit: str, window: int, k: int, same_doc: bool, resolve, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """``keyed`` texts dealt by row, and (row, spans) of the stretches that repeated windows cover.

    ``resolve`` maps BODY rows of whole anchors (sorted by anchor if ``ordered``) to SPAN rows. The texts are shuffled once, by row, and meet first
    the contexts to compare and then the spans.
    """
    texts = keyed(docs).repartition("row")
    found = staged(shared_places(keyed(docs), unit, window, k, same_doc), "anchors")
    wanted = found.where("not known").groupBy("row").agg(F.collect_list(F.struct("gram", "pos", "low", "high", "places")).alias("items"))
    bodies = texts.join(wanted, "row").select("row", "doc", "text", "items").mapInArrow(_bodies(unit), BODY_SCHEMA)
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a partition should be one shard
    dealt = bodies.repartition(parts, "gram")
    compared = (dealt.sortWithinPartitions("gram") if ordered else dealt).mapInArrow(resolve, SPAN_SCHEMA)
    known = found.where("known").select("row", F.col("pos") - F.col("low"), F.col("high") - F.col("pos"), F.explode("places").alias("p")).toDF("row", "back", "ahead", "p")
    spans = compared.union(known.select("row", (F.col("p") - F.col("back")).alias("low"), (F.col("p") + F.col("ahead")).alias("high")))
    return texts, spans.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover; touching intervals are one run."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.concatenate(([True], low[1:] > high[:-1]))[: len(low)]
    at = np.flatnonzero(first)
    return low[at], high[np.append(at[1:], len(low)) - 1] if len(low) else high
