"""WARC archives (operator 2): a writer with revisit records and a sequential, verifying reader.

One gzip member holds one record. The reader inflates member by member in small steps, frames each
record by its Content-Length, and checks block and payload digests as the bytes pass; no record is
held whole unless its payload is asked for. Archives are written by tasks under a shared location
through a file-system interface; names are unique to an attempt and only those in the manifest,
which winning attempts return, are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import checkpoint, filesystem, read, stored, work_dir

#: Payloads shorter than this are always written in full.
MIN_REVISIT_BYTES = 1000
#: An archive that has reached this size is closed and a new one begun.
ARCHIVE_BYTES = 1 << 30
STEP = 1 << 16
MOST_HEADER_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper halves of record UUIDs: a page's number is the lower half; the second is for rows without one.
_NUMBERED, _UNNUMBERED = 0x77617263_0000_4000, 0x77617263_0001_4000
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, error string"


def record_id(page_id: int | None) -> str:
    """The record's URN, from which ``page_of`` gets the page back."""
    if page_id is None:
        return f"<{uuid.UUID(int=_UNNUMBERED << 64 | uuid.uuid4().int & (1 << 64) - 1).urn}>"
    return f"<{uuid.UUID(int=_NUMBERED << 64 | page_id & (1 << 64) - 1).urn}>"


def page_of(urn: str | None) -> int | None:
    """The page of a record's URN; null for records of rows without a page_id, and for foreign URNs."""
    try:
        number = uuid.UUID(urn.strip("<>")).int if urn else 0
    except ValueError:
        return None
    if number >> 64 != _NUMBERED:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _stated(value: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a digest field, in base 32 or hex; null if absent or of a kind that is not known."""
    name, _, text = value.partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip()
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    size = hashlib.new(name).digest_size
    try:
        digest = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, digest) if len(digest) == size else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One gzip member with the page's response record, or with a revisit record if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: {_sha1(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Members:
    """Inflates the gzip members of a stream one after the other, at most ``STEP`` bytes at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.inflater = stream, b"", None

    def next_member(self) -> bool:
        """Goes to the next member; false at the end of the stream."""
        self.raw = self.raw or self.stream.read(STEP)
        self.inflater = zlib.decompressobj(31)
        return bool(self.raw)

    def read(self) -> bytes:
        """The member's next bytes; none at its end."""
        d = self.inflater
        while not d.eof:
            try:
                out = d.decompress(self.raw, STEP)
            except zlib.error as damage:
                raise ValueError(f"a member that cannot be inflated: {damage}") from damage
            self.raw = d.unused_data if d.eof else d.unconsumed_tail
            if out:
                return out
            if not d.eof and not self.raw:
                self.raw = self.stream.read(STEP)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
        return b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _one(members: _Members, with_payload: bool) -> dict:
    """The record of the present member."""
    held = b""
    while (end := held.find(b"\r\n\r\n")) < 0:
        more = members.read()
        if not more or len(held) > MOST_HEADER_BYTES:
            raise ValueError("a record without a complete header")
        held += more
    if not held.startswith(b"WARC/"):
        raise ValueError("a member that is no WARC record")
    fields = _fields(held[:end])
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        raise ValueError("a record without its type or length")
    left, held = int(fields["content-length"]), held[end + 4 :]
    stated = {of: _stated(fields.get(f"warc-{of}-digest", "")) for of in ("block", "payload")}
    running = {of: {name: hashlib.new(name) for name in {"sha1", *([known[0]] if known else [])}} for of, known in stated.items()}
    # records of other kinds than HTTP messages are payload throughout
    body = not fields.get("content-type", "").lower().startswith("application/http")
    http, kept, size = bytearray(), [], 0
    while left:
        held = held or members.read()
        if not held:
            raise ValueError("a record shorter than its Content-Length")
        part, held = held[:left], held[left:]
        left -= len(part)
        for digest in running["block"].values():
            digest.update(part)
        if not body:
            seen = max(0, len(http) - 3)
            http += part
            cut = http.find(b"\r\n\r\n", seen)
            if cut < 0 and len(http) <= MOST_HEADER_BYTES:
                continue
            # a message whose header does not end is payload as well
            body, part, http = True, bytes(http[cut + 4 :] if cut >= 0 else http), http[: max(cut, 0)]
        for digest in running["payload"].values():
            digest.update(part)
        size += len(part)
        if with_payload:
            kept.append(part)
    while more := members.read():
        held += more
        if len(held) > 4:
            break
    if held != b"\r\n\r\n":
        raise ValueError("a record that does not end with its Content-Length")
    revisit = fields["warc-type"] == "revisit"
    checked = [running[of][known[0]].digest() == known[1] for of, known in stated.items() if known and not (revisit and of == "payload")]
    length = _fields(bytes(http)).get("content-length", "")
    sha1 = stated["payload"][1].hex() if stated["payload"] and stated["payload"][0] == "sha1" else None
    out = {
        "page_id": page_of(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": (int(length) if length.isdigit() else None) if revisit else size,
        "payload_digest": sha1 if revisit else running["payload"]["sha1"].hexdigest(),
        "record_type": fields["warc-type"],
        "refers_to": page_of(fields.get("warc-refers-to")),
        "digest_ok": all(checked) if checked else None,
        "error": None,
    }
    return out | {"payload": b"".join(kept)} if with_payload else out


def read_records(stream, with_payload: bool = False, keep_on: bool = False) -> Iterator[dict]:
    """The records of one archive in order: their fields, what the bytes say, and whether digests hold.

    ``digest_ok`` is null where a record states no digest of a known kind. A record whose framing is
    broken (no header, type or length, a wrong length, bytes after its end, damage) raises ValueError;
    with ``keep_on`` it is a row of nulls with ``error``, and reading goes on at the next member, or
    ends where the members cannot be told apart any more.
    """
    members = _Members(stream)
    while members.next_member():
        try:
            yield _one(members, with_payload)
        except ValueError as broken:
            if not keep_on:
                raise
            yield dict.fromkeys([x.split()[0] for x in OUT.split(", ")]) | {"error": str(broken)}
            try:
                while members.read():
                    pass
            except ValueError:
                return


def mark_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to) of ``pages`` (page_id, url, html).

    Null html is empty. Among equal payloads of ``least`` bytes or more the largest page_id is kept
    in full (every row that has it, if rows repeat) and the others refer to it; if none of them has
    a page_id, all are kept in full.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # short payloads meet no other; a key of their own spreads them over the join
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    p = p.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")).otherwise(own))
    narrow = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    groups = narrow.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("digest"))
    firsts = stored(groups.agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").select("digest", "target"), "firsts")
    # both sides are dealt out for this join alone, so a digest with many pages can be split
    d = p.join(firsts, "digest", "left")
    return d.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) to archives under ``path``.

    Returns the manifest (path, n_records, n_bytes), checkpointed. The tables hold no fetch time, so
    ``date`` is a parameter. An empty table gives no archive.
    """

    def write(batches):
        import pyarrow as pa

        sink, name, done, n, size = None, "", [], 0, 0

        def close():
            sink.close()
            done.append({"path": name, "n_records": n, "n_bytes": size})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for row in zip(*columns, strict=True):
                if sink is None:
                    name, n, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, where = filesystem(name)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(where, compression=None)
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                member = record(page_id, url, payload, refers_to, date, level)
                sink.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return checkpoint(mark_revisits(pages).mapInArrow(write, "path string, n_records long, n_bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives: see ``OUT``; broken ones have ``error``. Archives are dealt out to tasks by name."""

    def rows(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
            + [("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("error", pa.string())]
        )
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, where = filesystem(name)
                held = []
                with store.open_input_stream(where, compression=None) as f:
                    for r in read_records(f, keep_on=True):
                        held.append(r)
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    dealt = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return dealt.mapInArrow(rows, OUT)


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back."""
    manifest = write_archives(read(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    d = read_archives(manifest)
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLE_SQL = {
    "op2_warc_roundtrip": """
        WITH p AS (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
          SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
        )
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to,
               TRUE AS digest_ok
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
    """
}
