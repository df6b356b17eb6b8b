"""WARC archives: write, normalise from monolithic gzip to one member per record, read back by offset.

A crawler may leave a whole WARC file as one gzip stream, which can only be read from its start. The
normaliser inflates such a stream once, in blocks, rewrites every record as a gzip member of its own and
writes a sidecar index with each member's offset and length. Files go to the shared folder by its own
file system; names carry the task attempt, and only the files of tasks that ended are listed in the
manifest, so a repeated task never mixes with an earlier one.

Defined results: a null payload is empty; a null id or URL gives a record without that header, and a row
without an id is always a response; rows that share an id, a digest and a size share one record type;
an empty table gives an empty manifest. Records are streamed; one record is held in memory at a time.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import materialise, shared_folder

#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes inflated at once.
BLOCK = 1 << 20
#: Smaller payloads are always stored.
REVISIT_BYTES = 1000
#: Fast compression; archives are written once and read a few times.
LEVEL = 1

_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed. A revisit keeps the HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + _CRLF * 2
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is None:
        head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    else:
        head += [f"WARC-Record-ID: {_record_id(page_id, digest)}", f"X-Page-ID: {page_id}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of WARC bytes into its records."""
    have, source = bytearray(), iter(chunks)
    more = True

    def fill() -> bool:
        nonlocal more
        part = next(source, None)
        more = part is not None
        have.extend(part or b"")
        return more

    while True:
        while (end := have.find(_CRLF * 2)) < 0 and fill():
            pass
        if end < 0:
            if have.strip():
                raise ValueError("the archive ends inside a record's header")
            return
        head = bytes(have[:end]).decode("utf-8")
        size = next(int(x.split(":", 1)[1]) for x in head.split("\r\n") if x.lower().startswith("content-length:"))
        total = end + 4 + size + 4
        while len(have) < total and fill():
            pass
        if len(have) < total:
            raise ValueError("the archive ends inside a record")
        yield bytes(have[:total])
        del have[:total]


def decode_record(record: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = record.partition(_CRLF * 2)
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(_CRLF * 2)
    said = next((int(x.split(b":")[1]) for x in http.split(_CRLF) if x.lower().startswith(b"content-length:")), 0)
    return fields | {"payload": payload, "payload-length": said}


def inflate(stream) -> Iterator[bytes]:
    """Blocks of a gzip stream's content, whatever the number of its members."""
    engine = zlib.decompressobj(31)
    while block := stream.read(BLOCK):
        while block:
            if out := engine.decompress(block, 4 * BLOCK):
                yield out
            block = engine.unconsumed_tail
            if engine.eof:
                block, engine = engine.unused_data, zlib.decompressobj(31)
    if out := engine.flush():
        yield out


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to.

    Payload digests are grouped without the payloads: the largest id of equal payloads keeps them. Only
    the list of revisits meets the pages again, by id, so that a payload that a third of the pages
    share neither moves nor gathers anywhere.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    size, digest = F.octet_length(html), F.sha1(html.cast("binary"))
    keys = pages.select("page_id", size.alias("size"), digest.alias("digest")).filter(size >= REVISIT_BYTES).filter("page_id IS NOT NULL")
    # In a table of its own, so that a hot payload's side of the join can be split.
    kept = materialise(keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-kept")
    revisits = keys.join(kept, ["digest", "size"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"), digest.alias("digest"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", kind.alias("record_type"), "refers_to")


def _names(folder: str) -> Iterator[str]:
    at = TaskContext.get()
    for n in range(1 << 40):
        yield posixpath.join(folder, f"part-{at.partitionId():05d}-{at.taskAttemptId()}-{n:04d}.warc.gz")


def write_monolithic(records: DataFrame) -> DataFrame:
    """Write archives of one gzip stream each; the manifest has path and n_records."""
    folder = shared_folder(records.sparkSession, "warc-mono")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out, done = _names(folder), None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    store, path = _open(next(names))
                    store.create_dir(posixpath.dirname(path), recursive=True)
                    out, engine, size, n = store.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                whole = lambda x: None if pd.isna(x) else int(x)
                record = encode_record(r.record_type, whole(r.page_id), None if pd.isna(r.url) else r.url, r.payload.encode(), r.digest, whole(r.refers_to))
                out.write(engine.compress(record))
                size, n = size + len(record), n + 1
                if size >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    done, out = [*done, (posixpath.basename(path), n)], None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((posixpath.basename(path), n))
        yield pd.DataFrame([(posixpath.join(folder, name), n) for name, n in done], columns=["path", "n_records"])

    # Ids as strings: a null would turn 64-bit ids into floats in pandas.
    rows = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(rows.mapInPandas(write, "path string, n_records long"), "warc-mono-manifest")


def _remove_archives(manifest: DataFrame) -> None:
    """Delete the folder of the archives that a manifest lists."""
    spark = manifest.sparkSession
    for r in manifest.select("path").limit(1).collect():
        place = spark._jvm.org.apache.hadoop.fs.Path(posixpath.dirname(r["path"]))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def normalise(manifest: DataFrame, remove: bool = False) -> DataFrame:
    """Inflate each archive once and rewrite every record as its own gzip member, with a sidecar index
    of lines `offset length`. The new manifest has path, index_path and n_records. With `remove`, the
    archives that it read are deleted in the end."""
    spark = manifest.sparkSession
    folder = shared_folder(spark, "warc")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _names(folder)
        for batch in batches:
            done = []
            for source in batch["path"]:
                target = next(names)
                store, path = _open(target)
                store.create_dir(posixpath.dirname(path), recursive=True)
                from_store, from_path = _open(source)
                lines, at = [], 0
                with from_store.open_input_stream(from_path, compression=None) as stream, store.open_output_stream(path, compression=None) as out:
                    for record in split_records(inflate(stream)):
                        engine = zlib.compressobj(LEVEL, wbits=31)
                        member = engine.compress(record) + engine.flush()
                        out.write(member)
                        lines.append(f"{at} {len(member)}\n")
                        at += len(member)
                with store.open_output_stream(f"{path}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                done.append((target, f"{target}.idx", len(lines)))
            yield pd.DataFrame(done, columns=["path", "index_path", "n_records"])

    parts = spark.sparkContext.defaultParallelism
    done = materialise(manifest.repartition(max(parts, 12)).mapInPandas(rewrite, "path string, index_path string, n_records long"), "warc-manifest")
    if remove:
        _remove_archives(manifest)
    return done


def read_back(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Read every record by its index entry and check its digest.

    page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits, or
    for all without `payloads`).
    The size of a revisited payload is the one that its stored HTTP header states.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index in zip(batch["path"], batch["index_path"], strict=True):
                store, at = _open(path)
                with store.open_input_stream(_open(index)[1], compression=None) as f:
                    entries = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
                with store.open_input_file(at) as f:
                    rows, size = [], 0
                    for offset, length in entries:
                        f.seek(offset)
                        r = decode_record(zlib.decompress(f.read(length), 31))
                        digest, revisit = r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
                            raise ValueError(f"a record of {path} at {offset} does not match its digest")
                        rows.append((r.get("x-page-id"), r.get("warc-target-uri"), r["warc-type"], r.get("x-refers-to-page-id"), digest, r["payload-length"], r["payload"].decode() if payloads and not revisit else None))
                        size += length
                        if size > 4 * BLOCK:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload string"
    parts = manifest.sparkSession.sparkContext.defaultParallelism
    out = manifest.repartition(max(parts, 12)).mapInPandas(read, kinds)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
