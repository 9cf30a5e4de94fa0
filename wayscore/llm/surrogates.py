"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

Detected entities go into one table of distinct (type, value). Each value gets a candidate from an HMAC of the key, the
type, the value and an attempt number, shaped like the value: digits for digits, letters for letters of the same case
and script, check digits that hold where they held. Candidates that two values share, or that are themselves real
values of the corpus, send all but the first value of each to its next attempt, until none is left. So one value has
one surrogate in all documents and two values never share one.

First names are permuted within their gender and script by the key, last names are spelt from syllables of their
script; each part of a name is replaced on its own, so that "Anna Berg" and "Ms Berg" stay one person.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import stored

#: First names by script and gender, syllables of last names by script, and titles that precede a last name.
FIRST = {
    ("latin", "f"): "Anna Maria Julia Laura Sarah Linda Susan Karen Nancy Helen Sophie Claire Monika Ingrid Teresa Carmen Isabel Nicole Emily Olivia".split(),
    ("latin", "m"): "James Robert Michael David Thomas Daniel Martin Stefan Andreas Pierre Philippe Carlos Miguel Antonio William Richard Joseph Kevin Brian Oliver".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Павел Владимир Юрий".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve wa".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()

_GENDER = {name: kind for kind, names in FIRST.items() for name in names}
_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_NAME = re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? )?(?P<first>{'|'.join(_GENDER)})(?: (?P<last>{_WORD}))?(?!\w)")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?P<last>{_WORD})(?!\w)")

#: Entities with digits or an @; the first that matches at a place wins.
_MARKED = re.compile(
    r"(?P<email>[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<!\w)(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,})(?!\w)"
    r"|(?:(?<!\w)(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?)(?P<secret>(?=[_\-+/]*[A-Za-z0-9])[A-Za-z0-9_\-+/]{8,})"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?<![\w\-])(?P<card>\d(?:[ \-]?\d){12,18})(?![\w\-])"
    r"|(?<![\w])(?P<phone>\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)"
)
_CUE = re.compile(r"[\d@]|(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]")


def _names() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in [*_GENDER, *(f"{t} " for t in TITLES), *(f"{t}. " for t in TITLES)]:
        found.add_word(word, word)
    found.make_automaton()
    return found


def find(text: str, names: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of the entities of a text, in order and apart."""
    out: list[tuple[int, int, str, str]] = []
    if _CUE.search(text):
        for m in _MARKED.finditer(text):
            kind = m.lastgroup
            out.append((m.start(kind), m.end(kind), kind, m[kind]))
    names = names or _names()
    if next(names.iter(text), None) is not None:
        taken = {i for s, e, _, _ in out for i in range(s, e)}
        for pattern in (_NAME, _TITLED):
            for m in pattern.finditer(text):
                for part in ("first", "last"):
                    if part in pattern.groupindex and m[part] and not taken.intersection(range(m.start(part), m.end(part))):
                        if part == "first" and m["last"] is None and m.start() == m.start("first"):
                            continue  # a lone first name is too often a common word, unless its person is in the text
                        kind = "name_" + part if part == "last" or m[part] not in _GENDER else "name_first"
                        out.append((m.start(part), m.end(part), kind, m[part]))
                        taken.update(range(m.start(part), m.end(part)))
        known: dict[str, str] = {}
        for _, _, kind, value in sorted(out):
            if kind.startswith("name"):
                known.setdefault(value, kind)
        for value in sorted(known, key=len, reverse=True):  # a double name before its parts
            for at in _mentions(text, value):
                if not taken.intersection(range(at, at + len(value))):
                    out.append((at, at + len(value), known[value], value))
                    taken.update(range(at, at + len(value)))
    return sorted(out)


def _mentions(text: str, name: str) -> Iterator[int]:
    """Where a name stands as a whole word."""
    at = text.find(name)
    while at >= 0:
        around = text[max(at - 1, 0) : at] + text[at + len(name) : at + len(name) + 1]
        if not any(c.isalnum() or c == "_" for c in around):
            yield at
        at = text.find(name, at + len(name))


class _Draw:
    """A stream of numbers from HMAC and SHAKE, as long as a value needs."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int, length: int):
        seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.bytes, self.at = hashlib.shake_256(seed).digest(8 * (length + 16)), 0

    def below(self, n: int) -> int:
        part = self.bytes[self.at : self.at + 8]
        self.at += 8
        return int.from_bytes(part, "big") % n

    def of(self, letters: str) -> str:
        return letters[self.below(len(letters))]


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _alike(value: str, draw: _Draw, hexadecimal: bool = False) -> str:
    lower = "abcdef" if hexadecimal else _LOWER
    return "".join(draw.of(_DIGITS) if c in _DIGITS else draw.of(lower) if c in _LOWER else draw.of(_UPPER) if c in _UPPER else c for c in value)


def luhn_digit(digits: str) -> str:
    """The check digit that goes after ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_holds(value: str) -> bool:
    flat = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _into(form: str, new: str) -> str:
    """The characters of ``new`` in place of those of ``form`` that are not separators, and what is left of them."""
    it = iter(new)
    return "".join([*(next(it) if c.isalnum() else c for c in form), *it])


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The candidate of a value; never the value itself. After the sixth attempt the formats grow, by more with each attempt."""
    for more in range(64):
        got = _candidate(key, kind, value, attempt, more)
        if got != value:
            return got
    raise ValueError("no surrogate differs from the value")


def _candidate(key: bytes, kind: str, value: str, attempt: int, more: int) -> str:
    wide = max(0, attempt - 5)
    draw = _Draw(key, kind, value, attempt * 64 + more, len(value) + 8 * wide)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")[:-2]
        local = _alike(local, draw)
        if wide or not any(c.isalnum() for c in local):
            local += "".join(draw.of(_LOWER) + draw.of(_DIGITS) + draw.of(_DIGITS) for _ in range(max(1, wide)))
        return f"{local}@{'.'.join([*(_alike(x, draw) for x in labels), 'example', ('com', 'net', 'org')[draw.below(3)]])}"
    if kind == "ip":
        def octet(x: str) -> str:
            low, high = (0, 255) if wide else {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(str(int(x)))]
            return str(low + draw.below(high - low + 1))
        return ".".join(octet(x) for x in value.split("."))
    if kind == "card":
        digits = "".join(c for c in value if c.isdigit())
        body = (draw.of(_DIGITS) if wide else digits[0]) + "".join(draw.of(_DIGITS) for _ in range(len(digits) - 2 + min(wide, max(0, 19 - len(digits)))))
        check = luhn_digit(body)
        if luhn_digit(digits[:-1]) != digits[-1]:
            check = str((int(check) + 1 + draw.below(9)) % 10)
        return _into(value, body + check)
    if kind == "phone":
        head = len(value) - len(value[1:].lstrip(_DIGITS)) if value[0] == "+" else 0
        rest = _alike(value[head:], draw) + "".join(draw.of(_DIGITS) for _ in range(wide))
        first = next((i for i, c in enumerate(rest) if c in _DIGITS), None)
        return value[:head] + (rest[:first] + draw.of("23456789") + rest[first + 1 :] if first is not None else rest)
    if kind == "iban":
        flat = value.replace(" ", "")
        body = _alike(flat[4:], draw) + "".join(draw.of(_DIGITS) for _ in range(wide))
        code = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
        code = code if iban_holds(value) else (code + 1 + draw.below(90)) % 97
        return _into(value, f"{flat[:2]}{code:02d}{body}")
    if kind == "key":
        return value[:4] + _alike(value[4:], draw) + "".join(draw.of(_UPPER) for _ in range(wide))
    if kind == "name_first":
        # a round trip through the names of this gender and script in keyed order: no two share a surrogate
        ring = sorted(FIRST[_GENDER[value]], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        return ring[(ring.index(value) + 1 + more) % len(ring)]
    if kind == "name_last":
        script = "cyrillic" if re.search("[А-Яа-яЁё]", value) else "latin"
        def spelt(part: str) -> str:
            size = max(4, len(part) + (draw.below(2 + 2 * wide) if wide else 0))
            return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(-(-size // 2)))[:size].capitalize()
        return "-".join(spelt(p) for p in value.split("-"))
    return _alike(value, draw, hexadecimal=re.fullmatch("[0-9a-f]+", value) is not None) + "".join(draw.of(_DIGITS) for _ in range(wide))


FOUND = "key long, size long, start int, end int, kind string, value string"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _names()
    for batch in batches:
        rows = []
        for key, size, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            rows += [(key, size, *e) for e in find(text.as_py(), names)]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "size", "start", "end", "kind", "value"])


def _candidates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, attempts = (batch.column(k).to_pylist() for k in range(3))
            new = [surrogate(key, k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return run


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt, surrogate for the distinct (kind, value) rows, no two of a kind with one surrogate and none
    of them a value of that kind. First names keep to their permutation, whose surrogates are names by design."""
    values = stored(entities.select("kind", "value").distinct())
    table = stored(values.withColumn("attempt", F.lit(0)).mapInArrow(_candidates(key), "kind string, value string, attempt int, surrogate string"))
    while True:
        first = table.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count(F.lit(1)).alias("n"))
        real = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        state = table.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        again = (F.col("kind") != "name_first") & (F.col("real").isNotNull() | ((F.col("n") > 1) & (F.col("owner") != F.col("value"))))
        state = stored(state.select("kind", "value", "attempt", "surrogate", F.coalesce(again, F.lit(False)).alias("again")))
        if not state.where("again").limit(1).count():
            return state.drop("again")
        moved = state.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_candidates(key), "kind string, value string, attempt int, surrogate string")
        table = stored(state.where("NOT again").drop("again").union(moved))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, edits in zip(batch.column(0), batch.column(1), strict=True):
            text, edits = text.as_py(), edits.as_py() or []
            if text is not None and edits:
                at, out = 0, []
                for e in sorted(edits, key=lambda e: e["start"]):
                    out += [text[at : e["start"]], e["surrogate"]]
                    at = e["end"]
                text = "".join([*out, text[at:]])
            texts.append(text)
            counts.append(len(edits))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()), *batch.columns[2:]], names=["_text", "_n", *batch.schema.names[2:]])


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with all columns, ``text`` with surrogates for its entities, and ``n_replaced`` after them (a column of
    that name is replaced).

    Entities: e-mail addresses, phone, card and social security numbers, IBANs, IPv4 addresses, access keys and secrets, and
    names with a known first name or a title and the parts of these anywhere else in the same text. Null and empty texts stay; repeated rows and copies get the same surrogates;
    rows need no id; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "n_replaced"]
    text = F.col("text").cast("string")
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], text.alias("_t"), F.xxhash64(text).alias("key"), F.coalesce(F.octet_length(text), F.lit(-1)).cast("long").alias("size"))
    # a copy's entities are the same, wherever it stands
    found = stored(rows.where("size > 0").select("key", "size", F.col("_t").alias("text")).mapInArrow(_detect, FOUND).distinct())
    table = surrogate_table(found, key)
    edits = found.join(table.select("kind", "value", "surrogate"), ["kind", "value"]).groupBy("key", "size").agg(F.collect_list(F.struct("start", "end", "surrogate")).alias("_e"))
    joined = rows.join(edits, ["key", "size"], "left")
    own = [F.col(f"_c{i}") for i, c in enumerate(names) if c != "text"]
    kinds = dict(docs.dtypes)
    schema = ", ".join(["_text string", "_n long", *[f"_c{i} {kinds[c]}" for i, c in enumerate(names) if c != "text"]])
    done = joined.select("_t", "_e", *own).mapInArrow(_replace, schema)
    return done.select(*[F.col("_text" if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_n").alias("n_replaced"))
