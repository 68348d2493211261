"""Media columns: Matroska files in a binary column, as packet tables and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm import matroska

PACKET = "track long, timestamp_ns long, key_frame boolean, lacing int, offset long, size long"
_PACKET = pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("key_frame", pa.bool_()), ("lacing", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])
_CUE = pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("cluster", pa.int64())])
#: Rows whose media are parsed together.
GROUP = 200


#: Tracks of a file's packets, the last packet's time, and the byte range that holds all of them.
SPAN = ("n_tracks", "last_packet_ms", "first_byte", "end_byte")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            raw = [(t or "").encode() for t in part.column(1).to_pylist()]
            padded = [r + b" " * (-len(r) % matroska.FRAME if r else matroska.FRAME) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(map(matroska.mux, padded), pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's UTF-8 bytes as samples.

    They are padded with blanks to a positive multiple of 192.  A null text is
    empty; rows are neither merged nor dropped, whatever their ids.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            found = []
            for data in part.column(part.num_columns - 1).to_pylist():
                try:
                    found.append(matroska.parse(data) if data is not None else None)
                except (matroska.Malformed, IndexError, ValueError):
                    found.append(None)
            packets = pa.array([[dict(zip(("track", "timestamp_ns", "key_frame", "lacing", "offset", "size"), p)) for p in m.packets] if m else None for m in found], pa.list_(_PACKET))
            cues = pa.array([[dict(zip(("timestamp_ns", "track", "cluster"), c)) for c in m.cues] if m else None for m in found], pa.list_(_CUE))
            clusters = pa.array([len(m.clusters) if m else None for m in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, packets, cues, clusters], names=[*part.schema.names, "packets", "cues", "clusters"])


def parse_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add ``packets`` (track, time, key frame, lacing and byte range of every
    frame, in file order), ``cues`` and ``clusters`` to rows with media.

    Null or malformed media: nulls.  Columns of those names are replaced.
    """
    rest = [c for c in df.columns if c not in (media_col, "packets", "cues", "clusters")]
    given = df.select(*rest, F.col(media_col))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(_parsed, f"{kind}, packets array<struct<track: bigint, timestamp_ns: bigint, key_frame: boolean, lacing: int, offset: bigint, size: bigint>>, cues array<struct<timestamp_ns: bigint, track: bigint, cluster: bigint>>, clusters bigint")


def packet_table(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per packet: the other columns, ``packet`` (from 0) and the packet's fields."""
    parsed = parse_media(df, media_col).drop(media_col, "cues", "clusters")
    return parsed.select(*(c for c in parsed.columns if c != "packets"), F.posexplode("packets").alias("packet", "_p")).select("*", "_p.*").drop("_p")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payload, feature, spans = [], [], []
        packets = batch.column(batch.schema.get_field_index("packets"))
        for at, data in enumerate(batch.column(batch.schema.get_field_index("media")).to_pylist()):
            own = packets[at].values
            if data is None or own is None:
                payload.append(None)
                feature.append(None)
                spans.append((None,) * len(SPAN))
                continue
            ranges = list(zip(own.field("offset").to_pylist(), own.field("size").to_pylist()))
            samples = b"".join([data[i : i + n] for i, n in ranges])
            times = own.field("timestamp_ns").to_pylist()
            spans.append((len(set(own.field("track").to_pylist())), max(times) // 1_000_000, min(i for i, _ in ranges), max(i + n for i, n in ranges)) if ranges else (0, None, None, None))
            payload.append(samples)
            wave = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
            crossings = int(np.count_nonzero(np.diff(wave >= 0)))
            feature.append(f"mean={wave.mean():.4f};rms={np.sqrt((wave**2).mean()):.4f};crossings={crossings}" if len(wave) else "mean=;rms=;crossings=0")
        rest = [c for c in batch.schema.names if c != "packets"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([len(p.values) if p.is_valid else None for p in packets], pa.int64()), pa.array(payload, pa.binary()), pa.array(feature), *(pa.array(c, pa.int64()) for c in zip(*spans))], names=[*rest, "n_packets", "payload", "wave", *SPAN])


def read_samples(parsed: DataFrame) -> DataFrame:
    """Replace ``packets`` by their number, ``payload`` (the bytes of their
    ranges, one after the other), ``wave``, features of these samples, and `SPAN`:
    the number of their tracks, the last one's time, and where the first range
    begins and the last one ends."""
    rest = parsed.drop("packets")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return parsed.mapInArrow(_read, f"{kind}, n_packets long, payload binary, wave string, {', '.join(f'{c} long' for c in SPAN)}")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a Matroska file, parse the file, and describe both.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature`` and `SPAN`.  The payload is read back from
    the packets' byte ranges.  Null text: empty.  Equal texts give equal
    values; an empty table gives no rows; other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, n_bytes long, media binary, cues array<struct<timestamp_ns: bigint, track: bigint, cluster: bigint>>, clusters bigint, n_packets long, payload binary, wave string, " + ", ".join(f"{c} long" for c in SPAN)
    read = given.mapInArrow(lambda batches: _read(_parsed(_stored(batches))), kind)  # the three steps in one worker
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "n_packets"), F.concat(F.lit("clusters="), "clusters"), F.concat(F.lit("cues="), F.size("cues")), "wave")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), *SPAN,
    )
