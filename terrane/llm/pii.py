"""Personal data: plain detection, and offset-preserving deobfuscation in front of a second detection.

Plain spans are the leftmost non-overlapping matches of a kind's pattern on the text itself, in time linear in the text: e-mails
grow from each ``@``, the other kinds from runs of digits.

Disguised ones: transducers rewrite the text and keep, for each character written, the source characters it stands for. They
map homoglyphs, forms of letters, digits and signs, and digits of other scripts to ASCII, drop invisible characters, turn ``[at]``, ``(dot)``,
``name at host dot org`` and the like into signs, and runs of at least ``MIN_SPELLED`` digits, three or more of them spelled, into
digits. ``point`` and a spaced ``.`` are signs only inside an address, as both are usual in prose: between four numbers, or in a
host that ends in a known top-level domain (after the bare words ``at`` and ``chez``, one that isn't a word as well: ``at some point
in`` and ``at noon . it`` are prose). Signs between equal fences (``-at-``, ``_dot_``, ``* at *``) count where a whole address is written so,
an ``@`` beside spaces before a dotted host that ends in a known domain, and signs written as character references or percent codes. The same
detectors read the normalised text; their spans are mapped back to source characters and added unless plain spans of that kind cover them.

Spans are code points, end exclusive. Cases: null and empty texts have no spans; repeated rows are judged alike; texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MIN_SPELLED = 7
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ZONE = re.compile(r"[+0-9][0-9 ().+-]*")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and _LOCAL.match(text, begin - 1):
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            out.append((begin, found.end()))
        # A failed attempt leaves nothing behind: no local part crosses an @.
        floor = found.end() if found else at + 1
        at = text.find("@", floor)
    return out


def _digit_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"ip": [], "card": [], "phone": []}
    for zone in _ZONE.finditer(text):
        begin, end = zone.span()
        if end - begin < 7:
            continue
        own = zone.group()
        if own.count(".") >= 3:
            at = 0
            while run := _DIGITS.search(own, at):  # a match starts where a run of digits does
                found = _IP.match(own, run.start())
                at = found.end() if found else run.end()
                if found and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in found.group().split(".")):
                    out["ip"].append((begin + found.start(), begin + found.end()))
        if end - begin >= 16:
            for found in _CARD.finditer(own):
                digits = found.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((begin + found.start(), begin + found.end()))
        if "+" in own:
            for found in _PHONE.finditer(own):
                if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
                    out["phone"].append((begin + found.start(), begin + found.end()))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Plain spans of each kind."""
    return {"email": _emails(text)} | _digit_spans(text)


# Cyrillic, Greek, Armenian and Latin letters that look like ASCII letters, and the letters they look like.
_LOOKS = dict(zip("аеорсухіјѕԁһӏмткнвԛԝүгАВЕКМНОРСТУХІЈЅӀԚԜαορνκιυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧօոսհցզքɑɡıɩɪʋſ", "aeopcyxijsdhlmtkhbqwyrABEKMHOPCTYXIJSlQWaopvkiuyABEZHIKMNOPTYXonuhgqpagiiiuf"))
#: Ranges of full-width, circled, squared, small and mathematical forms, which Unicode's compatibility mapping resolves.
_FORMS = ((0x2460, 0x24FF), (0xFE50, 0xFE6B), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x1F130, 0x1F189))
_LOOKS |= {chr(c): x for a, b in _FORMS for c in range(a, b + 1) if len(x := unicodedata.normalize("NFKC", chr(c))) == 1 and x.isascii()}
_LOOKS |= {chr(c): found[1].lower() for c in range(0x1D00, 0x1D23) if (found := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(c), "")))}
_LOOKS |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-") | dict.fromkeys("\u00a0\u2002\u2003\u2007\u2009\u202f\u3000", " ") | dict.fromkeys("\u2024\u3002\uff61", ".")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words, in English, German, French, Spanish, Italian, Portuguese and Dutch.
_SPELLED = {
    "0": "zero oh null zéro cero nul",
    "1": "one eins un uno um een",
    "2": "two zwei deux dos due dois twee",
    "3": "three drei trois tres tre três drie",
    "4": "four vier quatre cuatro quattro quatro",
    "5": "five fünf cinq cinco cinque vijf",
    "6": "six sechs seis sei zes",
    "7": "seven sieben sept siete sette sete zeven",
    "8": "eight acht huit ocho otto oito",
    "9": "nine neun neuf nueve nove negen",
}
_DIGIT_OF = {word: digit for digit, group in _SPELLED.items() for word in group.split()}
_NUMBER = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[ -]?)?(?:(?:{_NUMBER}|[0-9])[ .()-]{{1,3}}){{{MIN_SPELLED - 1},}}(?:{_NUMBER}|[0-9])(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"plus|{_NUMBER}|[0-9]", re.IGNORECASE)
_DIGIT_WORDS = frozenset(_DIGIT_OF) | frozenset("0123456789")


def _maybe_spelled(text: str) -> bool:
    """Whether some words stand in a row as in the inner part of a spelled run: much faster than the pattern, and true wherever it is."""
    words = text.lower().replace("-", " ").replace(".", " ").replace("(", " ").replace(")", " ").split()
    return b"\1" * (MIN_SPELLED - 2) in bytes([w in _DIGIT_WORDS for w in words])


_AT = r"(?:at|arroba|arobase|chez|@)"
_DOT = r"(?:dot|punto|punkt|point|\.)"
_SIGNS = re.compile(
    rf"(?P<at>\s*[\[({{<]\s*{_AT}\s*[\])}}>]\s*)|(?P<dot>\s*[\[({{<]\s*{_DOT}\s*[\])}}>]\s*)"
    rf"|(?P<bare>(?<=[A-Za-z0-9])\s+{_AT}\s+(?=[A-Za-z0-9-]+(?:\s+{_DOT}\s+[A-Za-z0-9-]+)+))|(?P<word>(?<=[A-Za-z0-9])\s+(?:dot|punto|punkt)\s+(?=[A-Za-z0-9]))"
    r"|(?P<weak>(?<=[A-Za-z0-9])\s+(?:point|\.)\s+(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
# Every branch of _SIGNS holds a bracketed sign or a dot between spaces.
_SIGNS_HINT = re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT})\s*[\])}}>]|\s{_DOT}\s", re.IGNORECASE)
_LINK = re.compile(r"[A-Za-z0-9._%+@-]+")
_BEFORE = re.compile(r"[A-Za-z0-9._%+@-]{1,64}\Z")
# Top-level domains that aren't words of prose, and those that are.
_DOMAINS = frozenset(
    "com org net edu gov mil int biz info example test ac ae af ag ai al ao aq ar aw ax az bb bd bf bg bh bi bj bm bn bo br bs bt bv bw bz ca cc cd cf cg ch "
    "ck cl cm cn cr cu cv cw cx cy cz de dj dk dm dz ec ee eg er fi fj fk fm fr gb gd gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hn hr ht hu ie im iq "
    "ir jm jo jp ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lu lv ly mc md mg mh mk ml mn mp mq mt mv mw mx mz nc nf ng nl np nr nz om pe pf pg "
    "ph pk pl pn pr ps pt pw py qa ro rs ru rw sb sc sd sg sj sk sl sm sn sr ss sv sx sy sz td tf tg th tj tk tl tm tn tr tt tw tz ua ug uk uy uz vc vg vi "
    "vn vu wf yt za zm zw".split()
)
_WORDS = frozenset(
    "ad am as at au ba be by ci co do es eu fo ga ge hm id il in io is it je la ma me mm mo mr ms mu my na ne ni no nu pa pm re sa se sh si so st su tc to "
    "tv us uz va ve ws ye aero app asia blog cat club coop dev email jobs live mobi museum name news online pro shop site space store tech tel travel "
    "website world xyz".split()
)
_DOMAIN_ENDS = _DOMAINS | _WORDS
# Signs as character references and percent codes.
_CODED = {"@": re.compile(r"%40|&(?:#0{0,5}64|#x0{0,5}40|commat);", re.IGNORECASE), ".": re.compile(r"%2e|&(?:#0{0,5}46|#x0{0,5}2e|period);", re.IGNORECASE)}
_FENCE_HINT = re.compile(r"[-_*~] {0,2}(?:at|arroba|arobase) {0,2}[-_*~]", re.IGNORECASE)
_FENCED_AT = re.compile(r"(?<=[A-Za-z0-9])\s{0,3}([-_*~]{1,3}) {0,2}(?:at|arroba|arobase) {0,2}\1\s{0,3}(?=[A-Za-z0-9])", re.IGNORECASE)
_FENCED_DOT = r"\s{{0,3}}{0} {{0,2}}(?:dot|punto|punkt|point|dott?) {{0,2}}{0}\s{{0,3}}(?=[A-Za-z0-9])"
_LABEL = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*?(?=\W|_|-|\Z)")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s{1,3}@\s{0,3}|@\s{1,3})(?=((?:[A-Za-z0-9-]+\.)+([A-Za-z]{2,24}))(?![A-Za-z0-9]))")
_STRANGE = frozenset(_INVISIBLE) | frozenset(_LOOKS) | frozenset(chr(c) for c in range(128, 0x20000) if unicodedata.decimal(chr(c), None) is not None)


class Tape:
    """A text, and the source span that each of its characters stands for, as runs: (place, source begin, source end, copied). In a copied
    run characters stand for one each; all of another stand for its whole span."""

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]]) -> None:
        self.text, self.runs = text, runs
        self.places = [r[0] for r in runs]

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, [(0, 0, len(text), True)])

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each (begin, end, new text) of this tape in ascending order replaced; new characters stand for the whole of it."""
        parts: list[str] = []
        runs: list[tuple[int, int, int, bool]] = []
        place = at = k = 0
        for begin, end, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:begin], new]
            while at < begin:  # what stays
                while k + 1 < len(self.runs) and self.places[k + 1] <= at:
                    k += 1
                start, source, stop, copied = self.runs[k]
                until = min(begin, self.places[k + 1] if k + 1 < len(self.runs) else begin)
                runs.append((place, source + at - start, source + until - start, True) if copied else (place, source, stop, False))
                place += until - at
                at = until
            if new:
                runs.append((place, *self.source(begin, end), False))
                place += len(new)
            at = end
        return Tape("".join(parts), runs)

    def _of(self, i: int) -> tuple[int, int]:
        start, source, stop, copied = self.runs[bisect_right(self.places, i) - 1]
        return (source + i - start, source + i - start + 1) if copied else (source, stop)

    def source(self, begin: int, end: int) -> tuple[int, int]:
        return self._of(begin)[0], self._of(end - 1)[1]


def _plain(char: str) -> str:
    if char in _INVISIBLE:
        return ""
    return _LOOKS.get(char) or str(unicodedata.decimal(char, char))


def _glyphs(tape: Tape) -> Tape:
    return tape.rewritten([(i, i + 1, _plain(c)) for i, c in enumerate(tape.text) if c in _STRANGE])


def _spelled(tape: Tape) -> Tape:
    edits = []
    for run in _SPELLED_RUN.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(tape.text, *run.span()))
        if sum(not p.group().isdigit() for p in parts) < 3:
            continue
        for i, part in enumerate(parts):
            word = part.group().lower()
            stop = parts[i + 1].start() if i + 1 < len(parts) else part.end()
            edits.append((part.start(), stop, "+" if word == "plus" else _DIGIT_OF.get(word, word)))
    return tape.rewritten(edits)


def _chains(text: str) -> Iterator[list[re.Match]]:
    """Signs with one word between each and the next."""
    chain: list[re.Match] = []
    for sign in _SIGNS.finditer(text):
        if chain and not _LINK.fullmatch(text, chain[-1].end(), sign.start()):
            yield chain
            chain = []
        chain.append(sign)
    if chain:
        yield chain


def _weak_dots(text: str, chain: list[re.Match]) -> set[int]:
    """Numbers of the weak dots of a chain that are inside an address."""
    last = _LINK.match(text, chain[-1].end())
    words = [m[0] if (m := _BEFORE.search(text, max(0, chain[0].start() - 64), chain[0].start())) else ""]
    words += [text[a.end() : b.start()] for a, b in zip(chain, chain[1:])] + [last[0].rstrip(".-") if last else ""]
    weak = [m.lastgroup == "weak" for m in chain]
    # A sentence ends where a capital follows.
    ends = [w and x[-1:].islower() and y[:1].isupper() and y[1:2].islower() for w, x, y in zip(weak, words, words[1:])]
    fine: set[int] = set()
    for i in range(len(chain) - 2):  # four numbers
        if all(w.isdigit() and len(w) <= 3 for w in words[i : i + 4]) and all(m.lastgroup in ("weak", "word", "dot") for m in chain[i : i + 3]):
            fine.update(k for k in range(i, i + 3) if weak[k])
    signs = [(i + 1, m.group().strip().lower(), m.lastgroup == "at") for i, m in enumerate(chain) if m.lastgroup in ("at", "bare")]
    signs += [(i, "@", True) for i, w in enumerate(words) if "@" in w.strip("@")]
    for host, sign, sure in signs:
        labels = [words[host].rpartition("@")[2]]
        dots: list[int] = []
        while host + len(dots) < len(chain) and "." not in labels[-1]:
            k = host + len(dots)
            if ends[k] or chain[k].lastgroup in ("at", "bare"):
                break
            dots.append(k)
            labels.append(words[k + 1])
            if "@" in labels[-1]:
                break
        tops = [x.lower().rpartition(".")[2] for x in labels]
        known = [n for n in range(1, len(tops)) if tops[n] in _DOMAINS and not (sign == "chez" and tops[n] in ("ai", "ca", "de"))]  # words of French
        if not known and sign not in ("at", "chez"):
            known = [n for n in range(1, len(tops)) if tops[n] in _WORDS] or ([1] if sure and len(tops) > 1 and len(tops[1]) > 1 and tops[1].isalpha() else [])
        if not known:
            continue
        host_dots = dots[: known[-1]]
        fine.update(k for k in host_dots if weak[k])
        # The name before the sign is parted in the way of the host.
        ways = {chain[k].group().strip().lower() for k in host_dots if weak[k]}
        k = host - 2 if "@" not in words[host] else host - 1
        while k >= 0 and chain[k].lastgroup not in ("at", "bare") and "@" not in words[k] and not ends[k] and (not weak[k] or chain[k].group().strip().lower() in ways):
            if weak[k]:
                fine.add(k)
            k -= 1
    return fine


def _signs(tape: Tape) -> Tape:
    edits = []
    for chain in _chains(tape.text):
        weak = _weak_dots(tape.text, chain) if any(m.lastgroup == "weak" for m in chain) else ()
        edits += [(*m.span(), "@" if m.lastgroup in ("at", "bare") else ".") for i, m in enumerate(chain) if m.lastgroup != "weak" or i in weak]
    return tape.rewritten(edits)


def _coded(tape: Tape) -> Tape:
    """Character references and percent codes of signs that stand between letters or digits."""
    edits = [(*m.span(), sign) for sign, pattern in _CODED.items() for m in pattern.finditer(tape.text) if _inner(tape.text, *m.span())]
    return tape.rewritten(sorted(edits))


def _inner(text: str, begin: int, end: int) -> bool:
    return begin > 0 and end < len(text) and text[begin - 1].isalnum() and text[end].isalnum()


def _fenced(tape: Tape) -> Tape:
    """Addresses whose signs are words between fences: the @, and each dot of the host, which ends in a known domain."""
    text, edits, floor = tape.text, [], 0
    for sign in _FENCED_AT.finditer(text):
        if sign.start() < floor:
            continue
        dot = re.compile(_FENCED_DOT.format(re.escape(sign[1])) + r"|\.(?=[A-Za-z0-9])", re.IGNORECASE)
        at, dots, last = sign.end(), [], 0
        while label := _LABEL.match(text, at):
            if dots and label[0].lower() in _DOMAIN_ENDS:
                last = len(dots)
            found = dot.match(text, label.end())
            if not found:
                break
            dots.append(found.span())
            at = found.end()
        if not last:
            continue
        edits.append((*sign.span(), "@"))
        edits += [(a, b, ".") for a, b in dots[:last]]
        floor = dots[last - 1][1]
    # Dots between fences in the name before the sign.
    before = []
    for begin, _, new in edits:
        if new == "@":
            for m in re.finditer(r"([-_*~]{1,3}) {0,2}dot {0,2}\1", text[max(0, begin - 64) : begin], re.IGNORECASE):
                span = max(0, begin - 64) + m.start(), max(0, begin - 64) + m.end()
                if _inner(text, *span) and not re.search(r"\s", text[span[1] : begin]):
                    before.append((*span, "."))
    merged: list[tuple[int, int, str]] = []
    for edit in sorted({*edits, *before}):
        if not merged or edit[0] >= merged[-1][1]:
            merged.append(edit)
    return tape.rewritten(merged)


def _spaced(tape: Tape) -> Tape:
    return tape.rewritten([(*m.span(), "@") for m in _SPACED_AT.finditer(tape.text) if m[2].lower() in _DOMAIN_ENDS])


def normalise(text: str) -> Tape | None:
    """The text without its disguises; None if it shows none."""
    strange = not text.isascii() and not _STRANGE.isdisjoint(text)
    tape = _glyphs(Tape.of(text)) if strange else None
    plain = tape.text if tape else text
    if ("%" in plain or "&" in plain) and any(p.search(plain) for p in _CODED.values()):
        tape = _coded(tape or Tape.of(text))
        plain = tape.text
    if _maybe_spelled(plain):
        tape = _spelled(tape or Tape.of(text))
    if _FENCE_HINT.search(plain):
        tape = _fenced(tape or Tape.of(text))
    if _SIGNS_HINT.search(plain):
        tape = _signs(tape or Tape.of(text))
    if " @" in plain or "@ " in plain or "\n@" in plain or "@\n" in plain:
        tape = _spaced(tape or Tape.of(text))
    return tape


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans and, with those behind disguises, all spans of each kind."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    every = {}
    for kind, spans in detect(tape.text).items():
        plain = base[kind]  # ascending, none overlaps another: only the last one that begins no later can cover a span
        begins = [a for a, _ in plain]
        found = [tape.source(*span) for span in spans]
        more = [(a, b) for a, b in found if not ((k := bisect_right(begins, a)) and plain[k - 1][1] >= b)]
        every[kind] = sorted(plain + more)
    return base, every


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, of overlapping ones their union, as ``<KIND>``."""
    parts, at = [], 0
    for begin, end, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if begin >= at:
            parts += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for text in batch.to_pylist():
            base, every = find(text or "")
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"])


def _redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else redacted(t, find(t)[1]) for t in batch.to_pylist()], pa.string())


def scan(docs: DataFrame) -> DataFrame:
    """Add the number of plain spans of each kind, their digest, and all spans, to every row (columns of these names are replaced)."""
    out = docs.withColumn("_p", F.arrow_udf(_scan, SCHEMA)("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return out.withColumns({n: F.col(f"_p.{n}") for n in names}).drop("_p")


def redact(docs: DataFrame) -> DataFrame:
    """Every row with the spans in its text replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``."""
    return docs.withColumn("text", F.arrow_udf(_redact, "string")("text"))
