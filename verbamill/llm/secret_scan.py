"""Secret scans: three base patterns, and novelty against a dictionary for what no pattern names.

A candidate of the second kind is an unbroken run of at least SHORTEST characters with both letters and digits that
begins within `near` characters of a sensitive word and meets no base span. Its cost is the bytes that zstandard needs
for it beyond those for the text around it alone, primed with a dictionary of identifiers and of `around` characters
of that text on either side. A run that costs at least the share `novel` of what a random run would says nothing that
its surroundings or the identifiers say. A random run costs its length, but from CODED characters on, where zstandard
codes literals, as many bytes as the kind of its characters needs (LATER of them being enough).

Spans are in code points, the end exclusive. Null and empty texts have none, and tables without rows give none. A long
text is scanned as a whole, in time that grows with its length. Spans that begin together are in order of kind.
Repeated rows each give a row. Other columns, whatever their names, are not read."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed patterns; the order of the kinds breaks ties between spans that start together.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_LEAST
KINDS = ("assign", "access", "hex", "novel")
#: Words after which an unbroken run may be a secret.
SENSITIVE = r"(?i:pass|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth|pwd)"
RUN, REST = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+/_=-]*"
NEAR, SHORTEST, AROUND, NOVEL = 48, 16, 2048, 0.7
CODED, LATER = 64, 0.9
#: Identifiers of common code and configuration.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "credential credentials authorization authenticate authentication bearer basic session cookie username user_name "
    "account config configuration settings environment variable default value string integer boolean function return "
    "import export require module package version release production development staging database connection server "
    "localhost https://www. http://example.com/ postgres:// mysql:// redis:// amazonaws.com us-east-1 endpoint request "
    "response header content-type application/json charset=utf-8 encoding timestamp created_at updated_at identifier "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 qwertyuiop xxxxxxxxxxxxxxxx 0000000000000000 "
    "BEGIN RSA PRIVATE KEY END CERTIFICATE ssh-rsa sha256 sha512 md5sum checksum signature issuer audience subject"
)


def random_bytes(run: str) -> float:
    """Bytes that a random run of that length and kind of characters needs."""
    kinds = (("0-9a-f", 4.0), ("0-9A-F", 4.0), ("0-9a-z", 5.17), ("0-9A-Z", 5.17))
    return len(run) * next((bits for chars, bits in kinds if re.fullmatch(f"[{chars}]+", run)), 6.0) / 8


class Scanner:
    def __init__(self, near: int = NEAR, around: int = AROUND, novel: float = NOVEL):
        import zstandard

        self.near, self.around, self.share = near, around, novel

        self.zstandard = zstandard
        self.assign, self.access, self.hex = (re.compile(x) for x in (ASSIGN, ACCESS, HEX))
        self.sensitive, self.run, self.rest = (re.compile(x) for x in (SENSITIVE, RUN, REST))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind, end)."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        return found + [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]

    def cost(self, before: str, run: str, after: str) -> int:
        """Bytes that the run adds to a compression primed with the identifiers and the text around it."""
        held = self.zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + after + "\n" + before).encode(), dict_type=self.zstandard.DICT_TYPE_RAWCONTENT)
        squeeze = self.zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=False, write_content_size=False)
        tail = before[-16:]
        return len(squeeze.compress((tail + run).encode())) - len(squeeze.compress(tail.encode()))

    def is_novel(self, text: str, start: int, end: int) -> bool:
        run = text[start:end]
        cost = self.cost(text[max(0, start - self.around) : start], run, text[end : end + self.around])
        return cost >= (self.share * len(run) if len(run) < CODED else LATER * random_bytes(run))

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """base: sorted spans. One pass over them and the candidates, both from left to right."""
        out, through, at, reached = [], -1, 0, -1
        for word in self.sensitive.finditer(text):
            # every run that starts near the word; those that an earlier word has led to are tested already
            while m := self.run.search(text, max(word.end(), through), word.end() + self.near + SHORTEST):
                if m.start() > word.end() + self.near:
                    break
                start, end = m.start(), self.rest.match(text, m.end()).end()  # the run may pass the stretch searched
                through = end
                while at < len(base) and base[at][0] < end:
                    reached, at = max(reached, base[at][2]), at + 1
                if reached <= start and re.search(r"[0-9]", text[start:end]) and re.search(r"[A-Za-z]", text[start:end]) and self.is_novel(text, start, end):
                    out.append((start, 3, end))
        return out

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans; both sorted by start, then kind."""
        if not text:
            return [], []
        base = sorted(self.base(text))
        return base, sorted(base + self.novel(text, base))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each stretch that spans cover replaced by the mark."""
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:  # else it overlaps what has been masked, which grows
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, around: int = AROUND, novel: float = NOVEL) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_novel)."""

    def start():
        scanner = Scanner(near, around, novel)

        def each(rows):
            found = [scanner.scan(text) for _, text in rows]
            counts = [[sum(k == kind for _, k, _ in x) for x, _ in found] for kind in range(3)]
            digests = [hashlib.sha256(said(x).encode()).hexdigest() for x, _ in found]
            return [[r[0] for r in rows], *counts, digests, [said(x) for _, x in found], [len(y) - len(x) for x, y in found]]

        return each

    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{x}", pa.int64()) for x in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, start, schema, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long").withColumnRenamed("doc_id", id_col)


def mask_secrets(docs: DataFrame, text_col: str = "text", near: int = NEAR, around: int = AROUND, novel: float = NOVEL) -> DataFrame:
    """docs with the secrets in its text replaced by a mark; other columns and rows as they are."""
    fields = docs.schema

    def start():
        scanner, at = Scanner(near, around, novel), fields.names.index(text_col)

        def each(rows):
            columns = [list(x) for x in zip(*rows)]
            columns[at] = [masked(x, scanner.scan(x)[1]) for x in columns[at]]
            return columns

        return each

    from pyspark.sql.pandas.types import to_arrow_schema

    return map_rows(docs, start, to_arrow_schema(fields), fields)
