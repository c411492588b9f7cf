r"""Credentials embedded in source code and configuration: found by entropy in context, and redacted in place.

Candidates are quoted strings and long tokens. Of each the Shannon entropy over its own alphabet is compared with
a threshold that grows with its length (a short string cannot reach the entropy of its alphabet); nothing is found without
passing it, but the edge of a key block that the chunk cuts off before its body. How strict the rest is depends on where it stands:
 - value of a field named as a secret (password, api key, auth token ...; the name must end so, which leaves
   out token_count, secret_name, api_key_header): enough entropy, and none of the exclusions;
 - password in a URL, Basic or Bearer header, user and password of a command line or a note: the same;
 - anywhere else: a known token shape, or a long token mixing upper and lower case and digits at random, not in
   a place for hashes, ids, public keys, certificates, images;
 - private key blocks, whole or cut off by the chunk's edge.
Excluded everywhere: placeholders, references to variables, files and stores, numbers, identifiers, header
names, URLs without a password, and outside of secret fields checksums and ids. A placeholder or a reference is the
whole value or its clear frame: a random value that holds such a word is one nevertheless.
The mask is a word, which stands in any string, URL, header, YAML or TOML value; of a key block each line is masked, so
that quotes, joints and line breaks stay.
A value over several lines (concatenated strings, key blocks) is one find, at its first line in the chunk.

Nulls, ties and odd input: null or empty content has no finds and stays as it is; repeated rows of an id count
once, at their earliest; rows without id are left out; overlapping finds are merged; an empty table gives no
rows; other columns are not read. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"

_SECRET = r"(?:pass(?:word|wd|wort|code)?|pass[_\- ]?phrase|pwd|pw|kennwort|contrase(?:n|ñ)a|mot[_ ]?de[_ ]?passe|secret|token|credentials?|auth|authorization|auth[_\- ]?header|(?:api|access|secret|signing|encryption|private|master|auth|account|service|deploy|webhook|license)[_\- ]?key)"
#: The name of a secret field up to its end, and what may stand between it and its value.
_FIELD = re.compile(
    rf"""(?i:(?<![a-z]){_SECRET}|(?<=[a-z]){_SECRET})(?![A-Za-z0-9_])(?P<glue>
      ["'`\])]{{0,2}}[ \t]*(?::[ \t]*(?:&?(?:'static\s+)?[Ss]tr(?:ing)?)[ \t]*)?(?::=|=>|=(?!=)|:(?!:)|,|\|\|)[ \t]*
    | \([ \t]*
    | ["']?[ \t]*,?[ \t]*\n[ \t]*["']?value["']?[ \t]*[:=][ \t]*
    | ["']?[ \t]+value[ \t]*=[ \t]*
    | ["']?>[ \t]*(?:<value>[ \t]*)?
    | [ \t]+(?:is[ \t]+|was[ \t]+)?(?=["'`])
    )(?:process\.env\.\w+\s*\|\|\s*|String::from\(\s*|[A-Za-z]+\(\s*(?=["'`])|[bBrRfFuU]{{1,2}}\#*(?=["'])|>-?\s*\n\s*|\|-?\s*\n\s*|\(\s*(?=["']))?""",
    re.VERBOSE,
)
_QUOTED = re.compile(r'''"""(.*?)"""|\'\'\'(.*?)\'\'\'|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`''', re.DOTALL)
_BARE = re.compile(r"[^\s\"'`<>,;{}()\[\]|]+")
_NEXT_PART = re.compile(r"""[ \t]*(?:[+.\\&][ \t]*)?\n[ \t]*(?:[+.][ \t]*)?(?=["'])""")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@\"'`<>]*:(?P<v>[^\s\"'`<>/]+(?:/[^\s\"'`<>/@]+)*)@(?=[A-Za-z0-9\[])")
_URL_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<v>[A-Za-z0-9_.\-]{16,})@(?=[A-Za-z0-9\[])")
_HEADER = re.compile(r"\b(?P<kind>[Bb]asic|BASIC|[Bb]earer|BEARER|[Tt]oken)[ \t]+(?P<v>[A-Za-z0-9+/=._~\-]{8,}(?:![\w]+)?)")
_COMMAND = re.compile(r"""(?:\s-u|--user|--userpwd)[\s=]+["']?[\w.@\-]*:(?P<v>[^"'\s]+)""")
_LOGIN = re.compile(r"(?i:\b(?:login|credentials?|log[ -]?in|user(?:name)?)\b[ \t]*(?:was|is|are|:|=)?[ \t]*)[\w.@\-]+[ \t]*/[ \t]*(?P<v>\S+)")
_IS_THE = re.compile(rf" (?:is|was) (?:the|our|my) (?:[\w\-]+ ){{0,3}}?(?i:{_SECRET})\b")
#: Words a name of _FIELD can begin with.
_STARTS = ("pass", "pwd", "pw", "kennwort", "contrase", "mot", "secret", "token", "credential", "auth", "api", "access", "signing", "encryption", "private", "master", "account", "service", "deploy", "webhook", "license")
_SHAPES = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bxox[abeoprs]-[A-Za-z0-9\-]{10,}|\beyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]*){1,2}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_.=\-])[A-Za-z0-9+/_.=\-]{20,}")
_BEGIN = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*)-----")
_END = re.compile(r"-----END (?P<kind>[A-Z0-9 ]*)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]+\Z|(?:Proc-Type|DEK-Info|Comment|Version): .*\Z")

_PLACEHOLDER = re.compile(r"(?i:none|null|nil|undefined|true|false|not[_\- ]?set|unset|to[_\- ]?do|tbd|n/?a)\Z|(.)\1{5,}\Z|[xX*.#\-_?]+\Z|<.*>\Z|\[.*\]\Z|.*EXAMPLE(?:KEY)?\Z", re.DOTALL)
#: Words of placeholders, beside which only plain words stand.
_MARKER = re.compile(r"(?i:change[_\- ]?(?:me|this|it)|replace[_\- ]?(?:me|this|with)|redacted|placeholder)|(?<![A-Za-z])(?i:example|sample|dummy|your|insert|put|here|to[_\- ]?do)(?![a-z])")
_REFERENCE = re.compile(r"\A[^\w]*(?:\$\{.*\}|\$\(.*\)|\{\{.*\}\}|%\([\w.\-]+\)[a-z])|\A%\w+%\Z|(?i:\A(?:env|vault|file|secret|secrets|ssm|kms|store|keyring|op|aws|gcp|azure|consul)[:.])|(?i:process\.env\b|\bgetenv\b|\benviron\b)|\A[A-Za-z]:\\|\Adata:[a-z]+/|\A(?:sha|md)\d+[:\-]|\A[a-z][a-z0-9+.\-]*://")
_IDENTIFIER = re.compile(
    r"\A(?:[A-Za-z]+(?:[_\-. ][A-Za-z]+)*|[a-z]+(?:[_\-. ][a-z]+)*\d{0,2}|[A-Z]+(?:[_\-. ][A-Z]+)*\d{0,2}|[A-Za-z][a-z]*(?:[A-Z][a-z]+)*\d{0,2}|(?:[A-Z][a-z]*|[A-Z]+)\d?(?:-(?:[A-Z][a-z]*|[A-Z]+)\d?)+|[a-z]+(?::[a-z0-9]+)+|[a-z_][a-z_]*(?:\.[a-z_][a-z_0-9]*)+|-?[\d.,:_%\- ]+[a-z]{0,2})\Z"
)
_UUID = re.compile(r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_HASH = re.compile(r"\A(?:(?:sha|md|blake)\d\w*[:\-])?[0-9a-fA-F]+\Z|\A(?:sha|md)\d+[:\-]")
_BENIGN = re.compile(r"(?i)public|\bicon|\bimage|base64,|\bsha-?\d|md5|etag|integrity|checksum|digest|hash|commit|revision|finger|cert|signature|uuid|guid|[_\- .]id\b|Id\b|nonce|\bssh-|\becdsa-|import|require|resolved")


def entropy(s: str) -> float:
    """Shannon entropy of the characters of ``s``, in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> int:
    """Size of the smallest alphabet that holds ``s``."""
    for size, pattern in ((10, r"[0-9]+"), (16, r"[0-9a-f]+|[0-9A-F]+"), (17, r"[0-9a-f\-]+|[0-9A-F\-]+"), (26, r"[a-z]+|[A-Z]+"), (37, r"[a-z0-9_\-]+|[A-Z0-9_\-]+"), (66, r"[A-Za-z0-9+/=_\-]+")):
        if re.fullmatch(pattern, s):
            return size
    return 95


def threshold(s: str) -> float:
    """Entropy that a random string of this length and alphabet reaches nearly always."""
    return 0.75 * math.log2(max(2, min(alphabet(s), len(s))))


def _named(v: str) -> bool:
    """Whether ``v`` is a name, a path or a number without a random part."""
    named = _IDENTIFIER.match(v) or re.match(r"(?:~|\.{1,2})?/", v)
    return bool(named) and all(len(p) < 12 and (_turns(p) < 0.6 or not p.isalpha()) or _turns(p) < 0.3 for p in re.split(r"[_\-./: ]", v))


def _placeholder(v: str) -> bool:
    if _PLACEHOLDER.match(v):
        return True
    rest = _MARKER.sub(" ", v)
    return rest != v and all(len(p) < 3 or p.isalpha() and _turns(p) < 0.3 for p in re.split(r"[^A-Za-z0-9]+", rest))


def _excluded(v: str) -> bool:
    return _placeholder(v) or bool(_REFERENCE.search(v)) or v[:1] in ("@", "$") and bool(re.fullmatch(r"[\w./:\-]*", v[1:])) and all(not p or _named(p) for p in re.split("[./:]", v[1:])) or _named(v)


def _kinds(v: str) -> int:
    return sum((any(map(str.isupper, v)), any(map(str.islower, v)), any(map(str.isdigit, v)), not v.isalnum()))


def secret_value(v: str) -> bool:
    """Whether the value of a field for secrets is one."""
    if " " in v and not v.isspace():  # parts of a random value, none a plain word
        parts = v.split(" ")
        return not any(c.isspace() for p in parts for c in p) and all(p and not (len(p) > 2 and p.isalpha()) for p in parts) and secret_value("".join(parts))
    if len(v) < 5 or any(c.isspace() for c in v) or _excluded(v):
        return False
    h, core = entropy(v), max(re.split("[^A-Za-z0-9]+", v), key=len)
    return (h >= threshold(v) or len(core) >= 16 and entropy(core) >= threshold(core)) and (h * len(v) >= 24 or _kinds(v) >= 3)


def _turns(v: str) -> float:
    """Share of neighbours of unlike kind (upper, lower, digit): high in random tokens, low in names."""
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in v]
    return sum(a != b for a, b in zip(kind, kind[1:])) / max(1, len(v) - 1)  # noqa: B905


def random_token(v: str) -> bool:
    """Whether a token without telling context is a random one over upper case, lower case and digits."""
    if _excluded(v) or _UUID.match(v) or _HASH.match(v):
        return False
    core = re.split(r"[_.\-](?=[^_.\-]*\Z)", v)[-1] if re.match(r"[A-Za-z]{2,8}[_.\-]", v) else v
    core = max(re.split(r"[_.\-]", v), key=len) if len(core) < 16 else core
    if len(core) < 16 or not (re.search("[A-Z]", core) and re.search("[a-z]", core) and re.search("[0-9]", core)):
        return False
    return _turns(core) >= 0.3 and entropy(core) >= threshold(core)


def _basic(v: str) -> bool:
    if entropy(v) < threshold(v):
        return False
    try:
        return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def _key_blocks(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Private key blocks, and what belongs to blocks of any other kind."""
    private: list[tuple[int, int]] = []
    other: list[tuple[int, int]] = []
    pos = 0
    marks = sorted([(m.start(), m, True) for m in _BEGIN.finditer(text)] + [(m.start(), m, False) for m in _END.finditer(text)], key=lambda x: x[0])
    k = 0
    while k < len(marks):
        at, m, begins = marks[k]
        own = private if "PRIVATE" in m["kind"] else other
        if begins:
            closes = next((j for j in range(k + 1, len(marks)) if not marks[j][2]), None)
            if closes is not None and not any(marks[j][2] for j in range(k + 1, closes)):
                end, k = marks[closes][1].end(), closes
            else:  # cut off by the end of the chunk: as far as lines look like the block's body
                end = m.end()
                for line in re.finditer(r"\n([^\n]*)", text[end:]):
                    if not _BODY.match(line[1].strip()):
                        break
                    end = m.end() + line.end()
            own.append((at, end))
        else:  # cut off by the start of the chunk
            start = text.rfind("\n", 0, at) + 1
            while start > max(pos, 0):
                above = text.rfind("\n", 0, start - 1) + 1
                if not _BODY.match(text[above : start - 1].strip()):
                    break
                start = above
            own.append((start, m.end()))
        pos = m.end()
        k += 1
    return [_lines_of(text, *x) for x in private if _random_body(text[x[0] : x[1]])], other


def _random_body(block: str) -> bool:
    """Whether what stands between the marks of a block is random; where the chunk holds none of it there is nothing to measure."""
    body = "".join(re.findall(r"[A-Za-z0-9+/]{4,}", re.sub(r"\\[nrt]|(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*", " ", _END.sub(" ", _BEGIN.sub(" ", block)))))
    return not body.strip() or entropy(body) >= threshold(body)


def _lines_of(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The part of each line of a block that is its own: without blanks, quotes and what joins strings."""
    spans = []
    while a < b:
        end = text.find("\n", a, b)
        end = b if end < 0 else end
        own = re.search(r"[A-Za-z0-9+/=\-](?:[^\n\"'`]*[A-Za-z0-9+/=\-])?", text[a:end])
        if own:
            spans.append((a + own.start(), a + own.end()))
        a = end + 1
    return spans


def _parts(text: str, at: int) -> tuple[str, list[tuple[int, int]], bool]:
    """The value that starts at ``at``, its places, and whether it is quoted; quoted parts joined over lines are one value."""
    m = _QUOTED.match(text, at)
    if not m and text[at - 1 : at] == ">":  # the text of an element, with its entities
        b = re.compile(r"[^\s<]+").match(text, at)
        if b and "&" in b[0]:
            return html.unescape(b[0]), [b.span()], True
    if not m:
        b = _BARE.match(text, at)
        if not b or text[b.end() : b.end() + 1] in ("(", "["):
            return "", [], False
        value = b[0].rstrip(".:") if b[0][-1] in ".:" else b[0]
        return value, [(at, at + len(value))], False
    spans = []
    while m:
        g = m.lastindex or 1
        spans.append(m.span(g))
        joint = _NEXT_PART.match(text, m.end())
        m = _QUOTED.match(text, joint.end()) if joint else None
    return "".join(text[a:b] for a, b in spans), spans, True


def find(text: str) -> list[list[tuple[int, int]]]:
    """The credentials of ``text``: of each its places in order, several where it is made of parts."""
    found, other = _key_blocks(text) if "-----" in text else ([], [])
    # Disjoint, in order; what overlaps blocks of other kinds is none of ours.
    taken = sorted([(f[0][0], f[-1][1]) for f in found if f] + other)
    lines = _Lines(text)

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(taken, (b, -1))
        return k == 0 or taken[k - 1][1] <= a

    def add(spans: list[tuple[int, int]]) -> None:
        if spans and spans[0][0] < spans[0][1] and all(free(*s) for s in spans):
            found.append(spans)
            for s in spans:
                bisect.insort(taken, s)

    for pattern in (_URL, _URL_TOKEN):
        if "://" in text:
            for m in pattern.finditer(text):
                if secret_value(m["v"]) if pattern is _URL else random_token(m["v"]) or _SHAPES.fullmatch(m["v"]) and _random_shape(m["v"]):
                    add([m.span("v")])
    for m in _HEADER.finditer(text):
        v = m["v"]
        if _basic(v) if m["kind"].lower() == "basic" else secret_value(v) and (len(v) >= 16 or m["kind"].lower() == "bearer" and re.search(r"\d", v)) and not (m["kind"].lower() == "token" and not random_token(v)):
            add([m.span("v")])
    for m in _fields(text):
        if re.search(r"(?i)public[_\- ]?\Z", text[max(0, m.start() - 8) : m.start()]):
            continue
        value, spans, quoted = _parts(text, m.end())
        if secret_value(value) and (quoted or not re.fullmatch(r"[A-Za-z_][\w.]*", value) or re.search(r"\d", value)):
            add(spans)
    for pattern in (_COMMAND, _LOGIN):
        for m in pattern.finditer(text):
            if secret_value(m["v"]):
                add([m.span("v")])
    for m in _IS_THE.finditer(text) if " the " in text or " our " in text or " my " in text else ():
        token = re.search(r"[^\s\"'`]+[\"'`]?\Z", text[text.rfind("\n", 0, m.start()) + 1 : m.start()])
        if token and secret_value(v := token[0].rstrip("\"'`")):
            end = m.start() - (len(token[0]) - len(v))
            add([(end - len(v), end)])
    for m in _SHAPES.finditer(text):
        if _random_shape(m[0]) and not lines.benign(m.start()):
            add(_whole(text, m.start(), m.end()))
    for m in _LONG.finditer(text):
        if m[0].islower() or m[0].isupper():
            continue
        v = m[0].strip("=") if not re.search(r"[A-Za-z0-9+/]={1,2}\Z", m[0]) else m[0]
        for name in re.finditer(r"\A[A-Za-z_.\-]+=", v):  # name=value without blanks
            v = v[name.end() :]
        a = m.start() + m[0].find(v)
        if len(v) >= 20 and random_token(v) and not lines.benign(a) and not _alone(text, a, a + len(v)):
            add(_whole(text, a, a + len(v)))
    first = re.match(r"""\s*["']([^"'\s]{8,})["'][\s)\];,+\\]*(?:\n|\Z)""", text)
    if first and secret_value(first[1]) and free(*first.span(1)):  # the rest of a value that began in the chunk before
        add([first.span(1)])
    return sorted(found)


def _fields(text: str) -> Iterator[re.Match[str]]:
    """The matches of _FIELD, tried only where one of its words begins."""
    low = text.lower()
    if len(low) != len(text):  # a letter that changes length
        yield from _FIELD.finditer(text)
        return
    starts = []
    for word in _STARTS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    end = 0
    for at in sorted(starts):
        if at >= end and (m := _FIELD.match(text, at)):
            yield m
            end = m.end()


def _random_shape(v: str) -> bool:
    """Whether a token of a known shape is random beyond its prefix, and no placeholder."""
    core = max(re.split(r"[_.\-]", v[4:] if v.startswith(("AKIA", "eyJ")) else v), key=len)
    return not _placeholder(v) and entropy(core) >= threshold(core)


class _Lines:
    """Where the words of hashes, ids, public keys and the like first stand in each line; every line is searched once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first: dict[int, int] = {}

    def _from(self, line: int) -> int:
        """The end of the first such word of the line, past the text if it has none."""
        if line not in self.first:
            end = self.text.find("\n", line)
            m = _BENIGN.search(self.text, line, len(self.text) if end < 0 else end)
            self.first[line] = m.end() if m else len(self.text) + 1
        return self.first[line]

    def benign(self, at: int) -> bool:
        line = self.text.rfind("\n", 0, at) + 1
        if self._from(line) <= at:
            return True
        # The name may stand on the line before.
        return bool(line and re.match(r"[ \t]*-?[ \t]*[\"']?value\b", self.text[line : min(at, line + 200)])) and self._from(self.text.rfind("\n", 0, line - 1) + 1) < line


def _alone(text: str, a: int, b: int) -> bool:
    """Whether nothing but the token stands on its line, as in the body of a certificate."""
    line = text.rfind("\n", 0, a) + 1
    end = text.find("\n", b)
    return not text[line:a].strip() and not text[b : len(text) if end < 0 else end].strip()


def _whole(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The token, with the further parts of the string it ends."""
    if text[b : b + 1] in ('"', "'"):
        joint = _NEXT_PART.match(text, b + 1)
        if joint:
            return [(a, b), *_parts(text, joint.end())[1]]
    return [(a, b)]


def redact(text: str, found: list[list[tuple[int, int]]]) -> str:
    """``text`` with each place of a find replaced; line breaks inside a find stay, so that lines keep their numbers."""
    out, at = [], 0
    for a, b in sorted(s for f in found for s in f):
        if a >= at:
            out += [text[at:a], MASK + "\n" * text.count("\n", a, b)]
            at = b
    return "".join(out) + text[at:]


def _once(chunks: DataFrame) -> DataFrame:
    return chunks.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("updated_at", "content")).alias("r")).select("id", "r.content")


def find_credentials(chunks: DataFrame) -> DataFrame:
    """(id, line_no, length) of every credential in content, line_no from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, lengths = [], [], []
            for i, text in zip(b["id"].to_pylist(), b["content"].to_pylist(), strict=True):
                for spans in find(text) if text else ():
                    ids.append(i)
                    lines.append(text.count("\n", 0, spans[0][0]) + 1)
                    lengths.append(sum(y - x for x, y in spans))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(lines, pa.int32()), pa.array(lengths, pa.int32())], names=["id", "line_no", "length"])

    return _once(chunks).mapInArrow(run, "id string, line_no int, length int")


def redact_credentials(chunks: DataFrame) -> DataFrame:
    """(id, content, credentials): content with the credentials masked, and their number; all chunks, found in or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["content"].to_pylist()
            found = [find(t) if t else [] for t in texts]
            yield pa.record_batch([b["id"], pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["id", "content", "credentials"])

    return _once(chunks).mapInArrow(run, "id string, content string, credentials int")
