"""Decoding of binary sensor packets held in tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import machines as MC
from ..session import staged
from .ordered import block_entries, index_block, number_rows, with_halo

# fixed values of the wire formats
AXIS_NAMES = ["ax_g", "ay_g", "az_g", "gx_dps", "gy_dps", "gz_dps", "roll_deg", "pitch_deg", "yaw_deg"]
COMPACT_MAGIC, COMPACT_VERSION, COMPACT_SAMPLE = b"IM", 1, 14
CRC_POLY, CRC_START = 0x1021, 0xFFFF


def decode_frames(df: DataFrame, key: list[str], idx: str, arrival: str, payload: str, chunk_rows: int = 1 << 14) -> DataFrame:
    """20-byte frames of each device's byte stream, over noise and chunk borders.

    Chunks are cut into blocks. What a block does to the stream depends only on how many bytes of a
    frame begun earlier it must skip (0..19), so each block first reports where it leaves off for
    every entry; composing these in a tree gives the real entries and all blocks decode in parallel. Output
    rows: key, block, arrival of the chunk where the frame starts, frame number in the block, axes,
    and ``discarded`` (bytes skipped in the block, on its first row; rows with NULL axes carry
    blocks without frames).
    """
    rows = df.filter(F.length(payload) > 0).select(*key, idx, F.col(arrival).alias("_a"), F.col(payload).alias("_p"))
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    size = MC.FRAME_BYTES
    # chunks without bytes are gone: counted anew, the next 20 chunks hold the 19 bytes a frame may need
    rows = staged(number_rows(rows, key, [idx], index_block(idx, chunk_rows), "_n"), "chunks")
    idx = "_n"
    h = with_halo(rows, idx, 0, size, chunk_rows)

    def load(pdf: pd.DataFrame):
        pdf = pdf.sort_values(idx)
        own = pdf["_core"].to_numpy()
        parts = [bytes(p) for p in pdf["_p"]]
        n = sum(len(p) for p, o in zip(parts, own) if o)
        return pdf, b"".join(parts), n

    def leave(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_core"].any():
            return pd.DataFrame(columns=[*key, "_blk", "_to"])
        _, data, n = load(pdf)
        known: dict[int, int] = {}

        def exit_from(pos: int) -> int:
            path = []
            while pos < n and pos not in known:
                path.append(pos)
                at = data.find(MC.FRAME_MAGIC, pos)
                pos = n if at < 0 or at >= n else at + size
            end = known.get(pos, pos - n)
            known.update(dict.fromkeys(path, end))
            return end

        return pd.DataFrame({**{k: [v] for k, v in zip(key, group)}, "_blk": [group[-1]], "_to": [[exit_from(s) for s in range(size)]]})

    maps = h.groupBy(*key, "_blk").applyInPandas(leave, f"{types}, _blk bigint, _to array<int>")
    steps = maps.withColumn("_none", F.lit(0))
    e = block_entries(steps, key, "_blk", ["_to"], "_none", lambda a, b: [[int(b[0][i]) for i in a[0]]], lambda m, state: int(m[0][int(state)]))
    e = e.withColumnRenamed("entry", "_in")

    def decode(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, data, n = load(pdf)
        starts, _, lost = MC.scan_frames(data, int(pdf["_in"].iloc[0]), n)
        if len(data) == n and data[-1:] == MC.FRAME_MAGIC[:1] and (not starts or starts[-1] + size < n):
            lost -= 1  # a lone first header byte at the end of the stream is still pending
        starts = [s for s in starts if s + size <= len(data)]
        edge = np.cumsum([len(p) for p in pdf["_p"]])
        raw = np.frombuffer(b"".join(data[s + 2:s + size] for s in starts), "<i2").reshape(-1, 9).astype(float)
        axes = raw * np.repeat([16.0, 2000.0, 180.0], 3) / 32768
        if not starts:
            axes = np.full((1, 9), np.nan)
        k = max(1, len(starts))
        out = pd.DataFrame(axes, columns=AXIS_NAMES)
        out.insert(0, "discarded", [lost] + [0] * (k - 1))
        out.insert(0, "frame", range(k))
        out.insert(0, "arrival", pdf["_a"].to_numpy()[np.searchsorted(edge, starts, "right")] if starts else pdf["_a"].iloc[0])
        out.insert(0, "block", group[-1])
        for name, v in zip(reversed(key), reversed(group[:-1])):
            out.insert(0, name, v)
        return out

    axes = ", ".join(f"{a} double" for a in AXIS_NAMES)
    out = h.join(e, [*key, "_blk"]).groupBy(*key, "_blk").applyInPandas(decode, f"{types}, block bigint, arrival double, frame int, discarded bigint, {axes}")
    return out.withColumns({a: F.nanvl(a, F.lit(None)) for a in AXIS_NAMES})


def crc_table() -> np.ndarray:
    """CRC16 (CCITT) of each single byte, computed from the polynomial."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ CRC_POLY, t << 1) & 0xFFFF
    return t.astype(np.uint16)


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC of equal-length byte rows."""
    table, crc = crc_table(), np.full(len(rows), CRC_START, np.uint16)
    for col in rows.T:
        crc = (crc << 8) ^ table[(crc >> 8) ^ col]
    return crc


def same_lengths(packets: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, byte rows) of the packets of each length; a null has length 0."""
    whole = pa.array(packets.fill_null(b""), pa.binary()) if packets.null_count else packets.cast(pa.binary())
    length = pc.binary_length(whole).to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield at, np.frombuffer(b"".join(whole.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), n)


def crc_of(payload: Column) -> Column:
    """CRC16 of each payload; NULL for NULL."""

    @F.arrow_udf("int")
    def run(packets: pa.Array) -> pa.Array:
        crc = np.zeros(len(packets), np.int32)
        for at, rows in same_lengths(packets):
            crc[at] = crc16(rows)
        return pa.array(crc, mask=packets.is_null().to_numpy(zero_copy_only=False))

    return run(payload)


def decode_compact(df: DataFrame, payload: str) -> DataFrame:
    """Add ``reason`` (NULL when good) and ``samples`` (array of structs) for compact packets."""
    names = ["ax_g", "ay_g", "az_g", "gx_dps", "gy_dps", "gz_dps"]
    sample = ",".join(["sequence_id:int"] + [f"{n}:double" for n in names])

    @F.arrow_udf(f"struct<reason:string,samples:array<struct<{sample}>>>")
    def run(packets: pa.Array) -> pa.Array:
        reason, count, good = np.full(len(packets), None, object), np.zeros(len(packets), np.int64), np.zeros(len(packets), bool)
        found = []
        for at, m in same_lengths(packets):
            n = m.shape[1]
            if n < 6:
                reason[at] = "too_short"
                continue
            head = (m[:, 0] == COMPACT_MAGIC[0]) & (m[:, 1] == COMPACT_MAGIC[1]) & (m[:, 2] == COMPACT_VERSION)
            fits = m[:, 3].astype(int) * COMPACT_SAMPLE + 6 == n
            same = crc16(m[:, :-2]) == np.ascontiguousarray(m[:, -2:]).view("<u2")[:, 0]
            reason[at] = np.select([~head, ~fits, ~same], ["unsupported_packet", "length_mismatch", "crc_failed"], None)
            ok = head & fits & same
            if not ok.any():
                continue
            body = np.ascontiguousarray(m[ok, 4:-2]).view("<i2").reshape(ok.sum(), (n - 6) // COMPACT_SAMPLE, 7)
            good[at[ok]], count[at[ok]] = True, body.shape[1]
            found.append((at[ok], body))
        edges = np.r_[0, np.cumsum(count)]
        values = np.zeros((edges[-1], 7), np.int16)
        for at, body in found:
            values[(edges[at][:, None] + np.arange(body.shape[1])).ravel()] = body.reshape(-1, 7)
        columns = [pa.array(values[:, 0].astype(np.int32) & 0xFFFF)] + [pa.array(values[:, 1 + i] * (16.0 if i < 3 else 2000.0) / 32768) for i in range(6)]
        rows = pa.StructArray.from_arrays(columns, ["sequence_id", *names])
        samples = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows, mask=pa.array(~good))
        return pa.StructArray.from_arrays([pa.array(reason, pa.string()), samples], ["reason", "samples"])

    d = df.withColumn("_d", run(payload))
    return d.withColumns({"reason": F.col("_d.reason"), "samples": F.col("_d.samples")}).drop("_d")
