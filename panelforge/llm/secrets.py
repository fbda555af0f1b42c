"""Secret scan: fixed patterns, and zstandard novelty for what they miss.

A candidate is a long unbroken run of key characters with letters, announced as
secret: by a word before it, a word in its block (the lines between blank ones) or
the heading of that, or by a reported run that it adjoins.  Its novelty is the number of bytes
that it adds to the compressed text around it, the compressor being primed with
a dictionary of public identifiers, per character.  Names and code that the
dictionary or the surroundings hold compress away; random strings do not and
are reported.  Ordinary long words compress little as well, so a run without a digit
must add more.  The lines of a PEM private key are reported whatever they add.
"""

from __future__ import annotations

import builtins
import importlib
import keyword
import re
import sys
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

# Kinds and patterns of the base spans, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Lower-case openings of the assign pattern; a text without any has no such span.
OPENINGS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ANNOUNCED = re.compile(r"passw|pwd|secret|token|api|key|credential|auth|bearer|private|signature|access|login", re.I | re.A)
BEFORE, AROUND = 48, 256  # characters searched for an announcing word, and compressed as surroundings
NOVELTY, NOVELTY_LETTERS = 0.75, 0.9  # bytes a character; the second for runs without a digit
#: As a block may be long, its announcing words must stand by themselves there.
WORD = re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|phrase)s?|pwd|secrets?|tokens?|api_?keys?|api|keys?|credentials?|auth(?:orization)?|bearer|private|signatures?|access|logins?)(?![A-Za-z])", re.I)
BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
HEADING = 80  # characters up to which a line by itself heads the next block
#: What may stand between two adjoining runs: a line break, also a written-out one, or a mark.
BETWEEN = re.compile(r"[.:,\"'\\]*(?:\r?\n[^\S\n]*)?[.:,\"'\\]*")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_GAP = r"(?:\s|\\+[nrt]|[\"',])*"
PEM_PART = re.compile(PEM_GAP + r"(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\n\\]*|([A-Za-z0-9+/=]+))")
PEM_END = re.compile(PEM_GAP + "-----END ")
SPANS = "array<struct<kind:string,start:long,end:long>>"


#: Standard modules whose names and descriptions make up the dictionary.
MODULES = ("argparse", "base64", "collections", "configparser", "csv", "datetime", "email.message", "hashlib", "http.client", "inspect", "json", "logging", "math", "os", "random", "re", "shutil", "socket", "ssl", "string", "subprocess", "threading", "tokenize", "unittest", "urllib.parse", "uuid", "zipfile")


@lru_cache(maxsize=1)
def identifiers() -> bytes:
    """A dictionary of public identifiers: keywords, builtins, and the names in
    some standard modules with their descriptions."""
    seen: dict[str, None] = {}
    for module in (builtins, *map(importlib.import_module, MODULES)):
        for name in sorted(dir(module)):
            seen.setdefault(name)
            for part in sorted(vars(getattr(module, name)) if isinstance(getattr(module, name), type) else ()):
                seen.setdefault(part)
            doc = getattr(getattr(module, name), "__doc__", None)
            seen.update(dict.fromkeys(re.findall(r"[A-Za-z]{5,}", doc if isinstance(doc, str) else "")))
    return "\n".join([*seen, *sorted(sys.stdlib_module_names), *keyword.kwlist, *OPENINGS]).encode()


class Novelty:
    """Marginal compressed bytes against a primed dictionary."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=19)
        self.pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def __call__(self, before: str, run: str, after: str) -> float:
        around = (before + " " + after).encode("utf-8", "replace")
        return (len(self.pack(around + b" " + run.encode())) - len(self.pack(around))) / len(run)


@lru_cache(maxsize=1)
def novelty() -> Novelty:
    return Novelty(identifiers())


def pem_parts(text: str) -> list[tuple[int, int]]:
    """The runs in the bodies of PEM private keys.  Of a body that has no end mark only
    the leading long runs count, and a short one if the text ends with it."""
    found: list[tuple[int, int]] = []
    for head in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        at, parts = head.end(), []
        while part := PEM_PART.match(text, at):
            at = part.end()
            if part.group(1):
                parts.append(part.span(1))
        if not PEM_END.match(text, at):
            n = next((i for i, (a, b) in enumerate(parts) if b - a < 16), len(parts))
            parts = parts[:n + 1] if parts[n:] and parts[n][1] == len(text.rstrip()) else parts[:n]
        found += [(a, b) for a, b in parts if any(c.isalnum() for c in text[a:b])]
    return found


def announced_blocks(text: str) -> list[tuple[int, bool]]:
    """(end, whether it is announced) of each block, by a word in it, in the heading
    just above it, or in the last line above it that begins with ``#``."""
    out, start, lead, section = [], 0, "", False
    for end, after in [*(m.span() for m in BLANK.finditer(text)), (len(text), len(text))]:
        marked = re.findall(r"(?m)^#.*", text[start:end])
        section = bool(WORD.search(marked[-1])) if marked else section
        out.append((end, section or bool(WORD.search(lead) or WORD.search(text, start, end))))
        last = text[max(text.rfind("\n", start, end) + 1, start):end].strip()
        alone = "\n" not in text[start:end].strip() and len(last) <= HEADING
        lead, start = last if alone or last.endswith(":") else "", after
    return out


def others_out(around: str) -> str:
    """Surroundings without other runs like keys: random characters there would make
    the compressor code all random characters shorter, and a copy of the key hide it."""
    return RUN.sub(lambda m: " " if any(c.isdigit() for c in m.group()) else m.group(), around)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in OPENINGS):
        # The whole run is taken before its length is looked at: a short one still uses up its text.
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    carrying = {b for _, _, b in found}  # ends of what is reported as secret, for adjoining runs
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b in found]
    body = pem_parts(text)
    found += [("novel", a, b) for a, b in body]
    taken += body
    blocks, k, until = None, 0, -1
    for m in RUN.finditer(text):
        run, (a, b) = m.group(), m.span()
        adjoins, until = until >= 0 and BETWEEN.fullmatch(text, until, a), -1
        if any(x < b and a < y for x, y in taken):
            until = b if b in carrying else -1
            continue
        if not any(c.isalpha() for c in run):
            continue
        if not adjoins and not ANNOUNCED.search(text, max(0, a - BEFORE), a):
            blocks = announced_blocks(text) if blocks is None else blocks
            while blocks[k][0] < a:
                k += 1
            if not blocks[k][1]:
                continue
        least = NOVELTY if any(c.isdigit() for c in run) else NOVELTY_LETTERS
        if novelty()(others_out(text[max(0, a - AROUND):a]), run, others_out(text[b:b + AROUND])) >= least:
            found.append(("novel", a, b))
            until = b
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame) -> DataFrame:
    """The spans of each row of ``docs`` (key, text).  A NULL text counts as empty
    and has none; repeated rows are scanned one by one."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py() or "")] for t in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["key", "spans"])

    return arrow_map(docs.select("key", "text"), run, f"key long, spans {SPANS}")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    out, at, until = [], 0, 0
    for _, a, b in spans_of(text):
        if a >= until:
            out += [text[at:a], mark]
        until = max(until, b)
        at = until
    return "".join([*out, text[at:]])


def listed(spans, *kinds: str):
    """kind:start:end of the spans of these kinds (all if none is named), comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(F.col("key").alias("doc_id"), *map(count, KINDS), F.sha2(listed(F.col("spans"), *KINDS[:3]), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
