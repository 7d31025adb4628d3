"""WARC archives compressed with Zstandard: one frame a record, a dictionary in the leading skippable frame.

The writer gives each task archives of its own with a dictionary fitted on a bounded sample of the archive's first
payloads; payloads that repeat become revisits of one response. The reader loads the dictionary, walks the frames by
their headers, decodes one at a time and checks what it says of itself: version, mandatory fields, lengths, digests."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.deploy import ship
from barloom.llm.common import reject_clash, shared_folder, small_enough, stored, text_batches, text_or_empty
from barloom.llm.files import Replacing, at


@dataclass(frozen=True)
class Params:
    """Payloads of at least `least` bytes that are equal become revisits. An archive is closed once it has
    archive_bytes; its dictionary of at most dictionary_bytes is fitted on its first sample_rows payloads, or those
    in its first sample_bytes."""

    least: int = 1000
    level: int = 3
    archive_bytes: int = 256 << 20
    dictionary_bytes: int = 64 << 10
    sample_rows: int = 200
    sample_bytes: int = 4 << 20


#: Magic numbers and the profile that the formats give.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Winners of payload groups are broadcast up to so many; beyond it they are dealt out under so many salts.
BROADCAST_GROUPS, SALTS = 200_000, 16
_READ = (
    "archive string, offset long, record_type string, record_id string, page_id long, target_uri string, date string, payload_bytes long, "
    "payload_digest string, refers_to long, refers_to_id string, payload binary, error string"
)


class Damaged(ValueError):
    """An archive or a record that is not what it says."""


# --- frames


def _fields_of(header: int) -> tuple[int, int]:
    """Bytes of a frame's header after magic and descriptor, and of its checksum."""
    single, size = header >> 5 & 1, header >> 6
    return (0 if single else 1) + (0, 1, 2, 4)[header & 3] + ((1 if single else 0), 2, 4, 8)[size], 4 * (header >> 2 & 1)


class _Forward:
    """Reads a file forwards."""

    def __init__(self, uri: str):
        system, path = at(uri)
        self._in, self.place = system.open_input_stream(path, compression=None, buffer_size=1 << 20), 0

    def take(self, n: int) -> bytes:
        got = self._in.read(n)
        self.place += len(got)
        if len(got) < n:
            raise Damaged(f"ends within a frame at {self.place}")
        return got

    def magic(self) -> int | None:
        """The next four bytes, or None at the end of the file."""
        got = self._in.read(4)
        self.place += len(got)
        if got and len(got) < 4:
            raise Damaged(f"ends within a frame at {self.place}")
        return struct.unpack("<I", got)[0] if got else None

    def close(self) -> None:
        self._in.close()


def _frame(source: _Forward, magic: int) -> bytes:
    """A whole frame after its magic number, by its block headers; nothing is decompressed."""
    out = [struct.pack("<I", magic), source.take(1)]
    more, checksum = _fields_of(out[1][0])
    out.append(source.take(more))
    last = False
    while not last:
        head = source.take(3)
        word = int.from_bytes(head, "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise Damaged(f"a block of an unknown kind at {source.place}")
        out += [head, source.take(1 if kind == 1 else size)]
    return b"".join([*out, source.take(checksum)])


def _decoder(dictionary: bytes | None) -> zstandard.ZstdDecompressor:
    if dictionary is None:
        return zstandard.ZstdDecompressor()
    if dictionary[:4] == struct.pack("<I", FRAME):
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def frames(uri: str) -> Iterator[tuple[int, bytes | Damaged]]:
    """Offset and content of each frame of an archive, with the dictionary that its leading skippable frame
    holds, itself compressed or not; other skippable frames are passed over. A frame that can't be decoded gives
    what is wrong with it, and the next ones follow; where the end of one can't be told, that is the last."""
    source = _Forward(uri)
    try:
        decoder, begun = zstandard.ZstdDecompressor(), 0
        while (magic := source.magic()) is not None:
            if magic in SKIPPABLE:
                held = source.take(struct.unpack("<I", source.take(4))[0])
                if magic == DICTIONARY and begun == 0:
                    decoder = _decoder(held)
            elif magic != FRAME:
                raise Damaged(f"no frame at {begun}")
            else:
                frame = _frame(source, magic)
                try:
                    out = decoder.decompressobj()
                    content = out.decompress(frame)
                    if not out.eof:
                        raise Damaged("a frame without an end")
                    size = zstandard.frame_content_size(frame)
                    if size not in (-1, len(content)):
                        raise Damaged(f"{len(content)} bytes in a frame of {size}")
                    yield begun, content
                except (zstandard.ZstdError, Damaged) as e:
                    yield begun, Damaged(str(e))
            begun = source.place
    except (Damaged, zstandard.ZstdError) as e:
        yield begun, Damaged(str(e))
    finally:
        source.close()


# --- records


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _record(kind: str, id_: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{id_}>"), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return _head(own) + block + b"\r\n\r\n"


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    """The same for rows that repeat a page with its payload, so that a revisit can name its response."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {page_id} {digest}").urn


def target_uri(url: str | None, page_id: int | None) -> str:
    """The page's address with what may not stand in a header's line or a URI percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, date: str, winner: int | None, winner_url: str | None) -> bytes:
    """A response with the payload, or with a winner a revisit of it that has the headers alone."""
    digest = hashlib.sha1(payload).hexdigest()
    kind = "response" if winner is None else "revisit"
    fields = [("WARC-Target-URI", target_uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if winner is not None:
        fields += [
            ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{record_id('response', winner, digest)}>"), ("WARC-Refers-To-Target-URI", target_uri(winner_url, winner)),
            ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(winner)),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(kind, record_id(kind, page_id, digest), date, fields, http if winner is not None else http + payload)


def _lines(data: bytes, start: int) -> tuple[list[str], int]:
    """The lines of a header from start, and where what follows the empty line begins."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise Damaged("a header without an end")
    return data[start:end].decode("utf-8", "replace").split("\r\n"), end + 4


def _named(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged(f"not a header's line: {line[:80]!r}")
        last = name.lower()
        out[last] = value.strip()
    return out


def _length(value: str) -> int:
    if not re.fullmatch("[0-9]+", value):
        raise Damaged(f"not a length: {value[:40]!r}")
    return int(value)


def _digest(value: str) -> str:
    """Lower-case hexadecimal of a labelled SHA-1, which may stand in base 32."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        raise Damaged(f"a digest of another kind: {kind[:40]!r}")
    if len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower()


def parse(data: bytes) -> dict:
    """The record that a frame's content is, with every length and digest checked."""
    lines, body = _lines(data, 0)
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged(f"not a record: {lines[0][:80]!r}")
    head = _named(lines[1:])
    for name in MANDATORY:
        if name not in head:
            raise Damaged(f"a record without {name}")
    length = _length(head["content-length"])
    block = data[body : body + length]
    if len(block) < length:
        raise Damaged(f"{len(block)} of {length} bytes of a block")
    if data[body + length :] != b"\r\n\r\n":
        raise Damaged("a record does not end where its length says")
    if "warc-block-digest" in head and _digest(head["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise Damaged("a block that is not its digest's")
    number = {name: _length(head[name].removeprefix("-")) * (-1 if head[name].startswith("-") else 1) for name in ("x-page-id", "x-refers-to-page-id") if name in head}
    out = {
        "record_type": head["warc-type"], "record_id": head["warc-record-id"].strip("<>"), "page_id": number.get("x-page-id"), "target_uri": head.get("warc-target-uri"), "date": head["warc-date"],
        "payload_bytes": len(block), "payload_digest": None, "refers_to": number.get("x-refers-to-page-id"), "refers_to_id": head.get("warc-refers-to", "").strip("<>") or None, "payload": block,
    }
    if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, start = _lines(block, 0)
        if not http[0].startswith("HTTP/"):
            raise Damaged(f"not an HTTP response: {http[0][:80]!r}")
        payload, said = block[start:], _named(http[1:]).get("content-length")
        out |= {"payload": payload, "payload_bytes": len(payload) if said is None else _length(said)}
        whole = out["record_type"] != "revisit"
        if out["payload_bytes"] != len(payload) and (whole or payload):
            raise Damaged(f"{len(payload)} of {out['payload_bytes']} bytes of a payload")
        if "warc-payload-digest" in head:
            out["payload_digest"] = _digest(head["warc-payload-digest"])
            if whole and out["payload_digest"] != hashlib.sha1(payload).hexdigest():
                raise Damaged("a payload that is not its digest's")
        if not whole:
            out["payload"] = None
    return out


# --- tables


def _trained(samples: list[bytes], p: Params) -> bytes | None:
    """A dictionary fitted on samples; too few or too plain ones give none."""
    try:
        return zstandard.train_dictionary(min(p.dictionary_bytes, sum(map(len, samples)) // 8), samples, level=p.level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


class _Archive:
    """An archive that is being written: dictionary, information on itself, then records."""

    def __init__(self, uri: str, samples: list[bytes], date: str, p: Params):
        self._out, self.size, self.uri = Replacing(uri), 0, uri
        held = _trained(samples, p)
        self._encoder = zstandard.ZstdCompressor(level=p.level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(held) if held else None)
        if held:
            packed = zstandard.ZstdCompressor(level=19).compress(held)
            self._put(struct.pack("<II", DICTIONARY, len(packed)) + packed)
        self.add(_record("warcinfo", uuid.uuid4().urn, date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self._encoder.compress(record))

    def close(self) -> None:
        self._out.close()


def winners(pages: DataFrame, p: Params = Params(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """name, winner, winner_url for each payload of at least p.least bytes that several rows hold: the row with
    the largest page_id. Payloads are told apart by their SHA-256; partial groups meet before the shuffle, so a
    payload that a third of all rows hold is a row a task."""
    body = text_or_empty(F.col(html))
    named = reject_clash(pages, key, url, html).where(F.octet_length(body) >= p.least)
    groups = named.select(F.sha2(body, 256).alias("name"), F.struct(F.col(key).cast("long").alias("winner"), F.col(url).alias("winner_url")).alias("row")).groupBy("name")
    return groups.agg(F.count(F.lit(1)).alias("rows"), F.max("row").alias("row")).where("rows > 1 AND row.winner IS NOT NULL").select("name", "row.*")


def write(pages: DataFrame, folder: str, p: Params = Params(), date: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row of pages into archives below folder; returns, stored, archive, records, bytes
    for each archive that is whole.

    A null html is an empty payload; of equal payloads the row with the largest page_id is the response, and so is
    any row that repeats it; rows without a page_id revisit others, or are all responses where none has one. An
    empty table writes nothing. Archives of a task that was lost are named by no row."""
    ship(pages.sparkSession)
    text_batches(pages.sparkSession)
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    groups = stored(winners(pages, p, key, url, html), "payload-groups")
    plain = reject_clash(pages, key, url, html).select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), text_or_empty(F.col(html)).alias("html"))
    plain = plain.withColumn("name", F.when(F.octet_length("html") >= p.least, F.sha2("html", 256)))
    if small_enough(groups, BROADCAST_GROUPS):
        met = plain.join(F.broadcast(groups), "name", "left")
    else:
        # Rows without a name would meet in one task, and so would those of a payload that many rows hold.
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = plain.where("name IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"], "left").drop("salt")
        met = own.unionByName(plain.where("name IS NULL").withColumns({"winner": F.lit(None).cast("long"), "winner_url": F.lit(None).cast("string")}))
    rows = met.select("page_id", "url", "html", *[F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col(c)).alias(c) for c in ("winner", "winner_url")])

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, waiting, bytes_, n, done = None, [], 0, 0, []

        def flush() -> None:
            nonlocal archive, waiting, bytes_, n
            if archive is None and waiting:
                name = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                archive, n = _Archive(name, [x[2] for x in waiting if x[3] is None], when, p), 0
            for page_id, address, payload, winner, winner_url in waiting:
                archive.add(page_record(page_id, address, payload, when, winner, winner_url))
                n += 1
            waiting, bytes_ = [], 0

        def end() -> None:
            nonlocal archive
            flush()
            if archive:
                archive.close()
                done.append((archive.uri, n, archive.size))
            archive = None

        for batch in batches:
            numbers = batch[["page_id", "winner"]].astype("Int64")
            for page_id, address, body, winner, winner_url in zip(numbers["page_id"], batch["url"], batch["html"], numbers["winner"], batch["winner_url"], strict=True):
                payload = body.encode("utf-8", "replace")
                waiting.append((None if pd.isna(page_id) else int(page_id), address, payload, None if pd.isna(winner) else int(winner), winner_url))
                bytes_ += len(payload)
                if archive or len(waiting) >= p.sample_rows or bytes_ >= p.sample_bytes:
                    flush()
                if archive and archive.size >= p.archive_bytes:
                    end()
        end()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    return stored(rows.mapInPandas(put, "archive string, records long, bytes long"), "archives")


def read(archives: DataFrame, payloads: bool = False, strict: bool = True, archive: str = "archive") -> DataFrame:
    """A row for each record of the archives: its archive and offset, type, ids, payload's length and SHA-1, what it
    refers to, and with `payloads` a response's payload. A revisit's length and digest are those it says of the
    full payload.

    A record that can't be decoded or is not what it says fails the job, or, if not strict, gives a row with
    `error` and nulls; records after it are read. An archive is read forwards by one task, a record at a time."""
    ship(archives.sparkSession)
    names = [x.split()[0] for x in _READ.split(", ")]

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["archive"]:
                out, size = [], 0
                for offset, content in frames(name):
                    row = dict.fromkeys(names) | {"archive": name, "offset": offset}
                    try:
                        if isinstance(content, Damaged):
                            raise content
                        row |= parse(content)
                    except Damaged as e:
                        if strict:
                            raise Damaged(f"{name} at {offset}: {e}") from e
                        row["error"] = str(e)
                    if not payloads:
                        row["payload"] = None
                    out.append(row)
                    size += len(row["payload"] or b"")
                    if len(out) >= 1000 or size >= 16 << 20:
                        yield _table(out, names)
                        out, size = [], 0
                if out:
                    yield _table(out, names)

    each = archives.select(F.col(archive).alias("archive")).distinct()
    return each.repartition("archive").mapInPandas(get, _READ)


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in ("offset", "page_id", "payload_bytes", "refers_to")})


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits with their payloads: a revisit's is that of the response it names, if its digest
    agrees, else null. Needs read(payloads=True)."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload")).dropDuplicates(["_id"])
    met = records.where("record_type IN ('response', 'revisit')").join(responses, (F.col("refers_to_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return met.withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_digest", "_payload")


def op11_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_folder(spark, "warc"))
    return read(archives).where("record_type != 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
