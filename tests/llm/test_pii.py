"""Personal data: plain spans against the patterns themselves, disguised ones by planted cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terrane.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    own = [int(d) for d in reversed(digits)]
    return sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits) % 10 == 0,
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if fine:
                spans.append(m.span())
        out[kind] = spans
    return out


def test_plain_spans_equal_the_patterns():
    rng = random.Random(8)
    for k in range(6000):
        pool = ["0123456789 .-+()@aZ_%", "0123456789.", "0123456789 -", "+0123456789 ().-", "ab.@-_+%9é"][k % 5]
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(70)))
        assert pii.detect(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "x4111-1111-1111-1111y 1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (555) 123-4567.", "999.1.1.1 01.02.003.0004"):
        assert pii.detect(text) == brute(text)


DISGUISED = [
    ("write to jane dot doe at example dot org now", "email", "jane dot doe at example dot org"),
    ("jane.doe [at] example [dot] org", "email", "jane.doe [at] example [dot] org"),
    ("jane(at)example(dot)org", "email", "jane(at)example(dot)org"),
    ("mail jаne@example.org", "email", "jаne@example.org"),  # a Cyrillic letter
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
    ("call plus four nine one five one two three four five six seven eight please", "phone", "plus four nine one five one two three four five six seven eight"),
    ("host 192​.168.0.1 up", "ip", "192​.168.0.1"),
    ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("marie chez exemple point fr", "email", "marie chez exemple point fr"),
    ("marie @ exemple . fr", "email", "marie @ exemple . fr"),
    ("marie (at) exemple point fr", "email", "marie (at) exemple point fr"),
    ("de marie point curie at exemple point fr et", "email", "marie point curie at exemple point fr"),
    ("marie@exemple point co point uk", "email", "marie@exemple point co point uk"),
    ("write to marie @ exemple . fr . Then wait", "email", "marie @ exemple . fr"),
    ("host 192 . 168 . 0 . 1 up", "ip", "192 . 168 . 0 . 1"),
    ("plus four 9 three 0 one 2 three 4 five 6", "phone", "plus four 9 three 0 one 2 three 4 five 6"),
]


@pytest.mark.parametrize("text, kind, secret", DISGUISED)
def test_disguises_are_mapped_back_to_source_characters(text, kind, secret):
    base, every = pii.find(text)
    begin = text.index(secret)
    assert (begin, begin + len(secret)) in every[kind]
    assert secret not in pii.redacted(text, every)
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)


def test_clean_texts_stay():
    for text in ("We met at ten. One or two of three.", "look at it, dot by dot", "version 1.2.3", "seven eight nine", "Москва и аорта", ""):
        assert not any(pii.find(text)[1].values()), text
        assert pii.redacted(text, pii.find(text)[1]) == text


def test_points_and_spaced_stops_of_prose_stay():
    for text in (
        "at this point in time", "look at it . Then go", "we arrived at noon . it was late", "at some point we met . at that point no one", "je suis chez moi . de plus",
        "mail a@b.org . Thanks", "see jane at work . in a week", "lunch @ noon . then home", "one . two . three", "1 . 2 . x",
    ):
        base, every = pii.find(text)
        assert base == every, text


def test_hints_let_through_all_that_the_transducers_read():
    rng = random.Random(5)
    signs = ["at", "@", "chez", "(at)", "[ dot ]", "dot", "point", ".", "punkt", "< . >", "x", "fr"]
    digits = ["plus", "one", "zwei", "tres", "un", "4", "5", "66", "x"]
    for _ in range(4000):
        text = " ".join(rng.choice(signs) for _ in range(8))
        assert pii._SIGNS_HINT.search(text) or not pii._SIGNS.search(text), text
        text = "".join(rng.choice(digits) + rng.choice([" ", " ", "-", ". ", ""]) for _ in range(24))
        assert pii._maybe_spelled(text) or pii._spelled(pii.Tape.of(text)).text == text, text


def test_queries_columns_and_redaction(spark):
    rows = [(1, "a@b.de and 10.0.0.1"), (2, None), (3, ""), (3, ""), (None, "+49 151 2345678 " * 2000), (5, "x [at] y [dot] de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(7))
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["spans"]) == (1, 1, "email:0:6,ip:11:19")
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:11:19").hexdigest()
    assert got[2]["spans"] == "" and got[None]["n_phone"] == 2000
    assert got[5]["n_email"] == 0 and got[5]["spans"] == "email:0:17"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] == "<EMAIL> and <IP>" and clean[2] is None and clean[5] == "<EMAIL>"
    assert pii.scan(docs.limit(0)).count() == 0


def test_tapes_of_rewritten_tapes_keep_source_spans():
    rng = random.Random(12)
    for _ in range(400):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randrange(30)))
        tape, spans = pii.Tape.of(text), [(i, i + 1) for i in range(len(text))]
        for _ in range(3):
            edits, at = [], 0
            while at < len(tape.text) and rng.random() < 0.7:
                begin = rng.randrange(at, len(tape.text))
                end = rng.randrange(begin, min(len(tape.text), begin + 4)) + 1
                edits.append((begin, end, "x" * rng.randrange(3)))
                at = end
            new, at = [], 0
            for begin, end, text_ in edits:
                new += spans[at:begin] + [(spans[begin][0], spans[end - 1][1])] * len(text_)
                at = end
            tape, spans = tape.rewritten(edits), new + spans[at:]
            assert len(tape.text) == len(spans)
            assert all(tape.source(i, i + 1) == s for i, s in enumerate(spans))


def disguised(rng):
    """A text with one disguised identifier, its kind and its place."""
    looks = {}
    for strange, plain in pii._LOOKS.items():
        looks.setdefault(plain, []).append(strange)
    words = {}
    for word, digit in pii._DIGIT_OF.items():
        words.setdefault(digit, []).append(word)
    kind = rng.choice(["email", "phone", "ip", "card"])
    if kind == "email":
        parts = ["".join(rng.choice("abcdehimnoprstuy") for _ in range(rng.randrange(4, 9))) for _ in range(3)]
        at, dot = rng.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("@", "."), (" chez ", " point "), ("{at}", "."), (" arroba ", " punto "), (" @ ", " . ")])
        secret = rng.choice(parts[:1] + [parts[0] + dot + parts[1]]) + at + parts[2] + dot + rng.choice(["com", "org", "fr", "de", "net"])
    elif kind == "phone":
        digits = "".join(rng.choice("0123456789") for _ in range(11))
        secret = rng.choice(["+" + digits[:2] + " " + digits[2:5] + "-" + digits[5:], "plus " + " ".join(rng.choice(words[d]) if rng.random() < 0.8 else d for d in digits)])
    elif kind == "ip":
        secret = ".".join(str(rng.randrange(256)) for _ in range(4))
    else:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        secret = rng.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    plain = not pii.detect(secret)[kind]
    hide = lambda c: rng.choice(looks[c]) if c in looks and not (plain and c in " .-") else c
    if not plain or rng.random() < 0.4:
        few = set(rng.sample(range(len(secret)), 2))
        secret = "".join(hide(c) if i in few else c for i, c in enumerate(secret)) if not any(w in pii._DIGIT_OF for w in secret.split()) else secret
    if rng.random() < 0.3 and not plain:
        at = rng.randrange(1, len(secret))
        secret = secret[:at] + rng.choice(pii._INVISIBLE) + secret[at:]
    before = rng.choice(["", "so: ", "é - ", "mail "])
    return before + secret + rng.choice(["", "\nnext", ", fine"]), kind, (len(before), len(before) + len(secret))


def test_recall_on_generated_disguises():
    rng, met, total = random.Random(21), 0, 2000
    for _ in range(total):
        text, kind, span = disguised(rng)
        met += any(a <= span[0] and span[1] <= b for a, b in pii.find(text)[1][kind])
    assert met / total >= 0.95, met / total


#: Written by hand along with the rules: a disguise, and what of it is the identifier.
BY_HAND = [
    ("email", "Write to bob @ example.com today", "bob @ example.com"),
    ("email", "Write to bob@ example.com today", "bob@ example.com"),
    ("email", "contact: anna.lee @mail.example.org.", "anna.lee @mail.example.org"),
    ("email", "bob -at- example -dot- com", "bob -at- example -dot- com"),
    ("email", "mail bob-at-example-dot-com please", "bob-at-example-dot-com"),
    ("email", "bob _at_ example _dot_ com", "bob _at_ example _dot_ com"),
    ("email", "bob*at*example*dot*co*dot*uk!", "bob*at*example*dot*co*dot*uk"),
    ("email", "bob~at~example.net", "bob~at~example.net"),
    ("email", "Écris à marie [arobase] exemple [point] fr", "marie [arobase] exemple [point] fr"),
    ("email", "marie arobase exemple point fr", "marie arobase exemple point fr"),
    ("email", "?to=bob%40example.com&x=1", "bob%40example.com"),
    ("email", "<a>bob&#64;example.com</a>", "bob&#64;example.com"),
    ("email", "bob&#x40;example&#46;com", "bob&#x40;example&#46;com"),
    ("email", "bob&commat;example&period;com", "bob&commat;example&period;com"),
    ("email", "j.doe (at) uni-x (dot) edu", "j.doe (at) uni-x (dot) edu"),
    ("email", "J DOT DOE AT EXAMPLE DOT COM", "J DOT DOE AT EXAMPLE DOT COM"),
    ("email", "sales{at}example{dot}biz", "sales{at}example{dot}biz"),
    ("email", "Mail: hans<at>beispiel.de", "hans<at>beispiel.de"),
    ("email", "b\u043eb@example.com", "b\u043eb@example.com"),
    ("email", "bob\uff20example\uff0ecom", "bob\uff20example\uff0ecom"),
    ("email", "bo\u200bb@exam\u00adple.com", "bo\u200bb@exam\u00adple.com"),
    ("phone", "call plus four four two zero seven nine four six zero nine five", "plus four four two zero seven nine four six zero nine five"),
    ("phone", "+\u0664\u0669 30 901820", "+\u0664\u0669 30 901820"),
    ("ip", "at 192 dot 168 dot 0 dot 1 now", "192 dot 168 dot 0 dot 1"),
    ("ip", "10[.]0[.]0[.]7", "10[.]0[.]0[.]7"),
    ("card", "4111\u20111111\u20111111\u20111111", "4111\u20111111\u20111111\u20111111"),
    ("card", "four one one one one one one one one one one one one one one one", "four one one one one one one one one one one one one one one one"),
]
#: Not read: words and signs apart by nothing else, letters for signs, or the reverse of a text.
NOT_READ = ["bob AT_SIGN example PERIOD com", "moc.elpmaxe@bob", "bob (you know what) example.com", "bobATexampleDOTcom"]
CLEAN = [
    "Look at home. Then go.", "day-at-a-time, state-of-the-art", "He sat -at- the door - dot - and left.", "50% of it & more; 40 %", "a * at * b and c", "x%40y", "Meet me @ noon. Bring it.",
    "The price @ 5.50 is fair", "foo _at_ bar", "R&D at site.", "one @ a time", "&#64; and &commat;", "at 5 point 2 percent", "see you @ the.end of it", "snake_at_case.value is set",
]


@pytest.mark.parametrize("kind, text, secret", BY_HAND)
def test_disguises_written_by_hand(kind, text, secret):
    begin = text.index(secret)
    assert (begin, begin + len(secret)) in pii.find(text)[1][kind]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert not any(pii.find(text)[1].values())


def test_what_is_not_read_is_known():
    assert sum(any(pii.find(text)[1].values()) for text in NOT_READ) == 0


#: Ways to hide identifiers that were put together after the rules, and by which no rule was changed: 28 of 48 are read.
LATER = [
    ('email', 'john.smith (at) gmail (dot) com'),
    ('email', 'john.smith[at]gmail.com'),
    ('email', 'john dot smith at gmail dot com'),
    ('email', 'john.smith AT gmail DOT com'),
    ('email', 'john.smith@gmail(dot)com'),
    ('email', 'john.smith at gmail.com'),
    ('email', 'john.smith (@) gmail.com'),
    ('email', 'john.smith @ gmail . com'),
    ('email', 'john.smith{at}gmail{dot}com'),
    ('email', 'john.smith <at> gmail <dot> com'),
    ('email', 'john.smith|at|gmail|dot|com'),
    ('email', 'john.smith "at" gmail "dot" com'),
    ('email', "john.smith 'at' gmail 'dot' com"),
    ('email', 'john.smith /at/ gmail /dot/ com'),
    ('email', 'john.smith=at=gmail.com'),
    ('email', 'john.smith#at#gmail.com'),
    ('email', 'john.smith((at))gmail((dot))com'),
    ('email', 'john.smith [ at ] gmail [ dot ] com'),
    ('email', 'john.smith＠gmail．com'),
    ('email', 'john.smith&#064;gmail.com'),
    ('email', 'john.smith%40gmail%2Ecom'),
    ('email', 'john.smith\\x40gmail.com'),
    ('email', 'john.smith\\u0040gmail.com'),
    ('email', 'j o h n @ g m a i l . c o m'),
    ('email', 'john.smith@gmail,com'),
    ('email', 'john.smith@gmail com'),
    ('email', 'john.smith@NOSPAM.gmail.com'),
    ('email', 'johnREMOVE@gmail.com'),
    ('email', 'ｊｏｈｎ＠ｇｍａｉｌ．ｃｏｍ'),
    ('email', 'john＿smith (ät) gmx (Punkt) de'),
    ('email', 'john arroba gmail punto com'),
    ('email', 'john chez orange point fr'),
    ('email', 'john (klammeraffe) web.de'),
    ('email', 'john [snabel-a] post.dk'),
    ('email', 'jоhn@gmаil.com'),
    ('phone', '+1 (five five five) 123 4567'),
    ('phone', '+44 seven seven zero zero nine zero zero one two three'),
    ('phone', 'plus one five five five one two three four five six seven'),
    ('phone', '+１ ５５５ １２３ ４５６７'),
    ('phone', '+1-555-O12-3456'),
    ('ip', '192[.]168[.]1[.]10'),
    ('ip', '192.168[.]1.10'),
    ('ip', '192 . 168 . 1 . 10'),
    ('ip', '192(dot)168(dot)1(dot)10'),
    ('ip', '192,168,1,10'),
    ('card', '4111.1111.1111.1111'),
    ('card', '4111 1111 1111 １１１１'),
    ('card', '４１１１１１１１１１１１１１１１'),
]


def test_recall_on_ways_that_no_rule_was_made_for():
    met = sum(any(a <= 3 and b >= len(text) - 3 for a, b in pii.find(text)[1][kind]) for kind, text in LATER)
    assert met >= 28
