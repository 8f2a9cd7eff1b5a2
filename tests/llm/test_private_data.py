import random
import re

import pytest

from cultiva.llm.private_data import KINDS, find_private_data, find_spans, mask_private_data, plain_spans

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def checksum(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def by_patterns(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and checksum(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((*m.span(), kind))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(8)
    signs = ["@", "a", "b.", ".", "1", "22", "255", "300", " ", "-", "+", "(", "%", "4242", "é", "com", "000"]
    for _ in range(8000):
        text = "".join(rng.choices(signs, k=rng.randrange(25)))
        assert plain_spans(text) == by_patterns(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("ask curator [at] strains [dot] org now", "email", "curator [at] strains [dot] org"),
        ("curator.two at strains dot example dot org", "email", "curator.two at strains dot example dot org"),
        ("curаtor@strаins.org", "email", "curаtor@strаins.org"),
        ("lab phone plus four nine three zero five five five one two three four.", "phone",
         "plus four nine three zero five five five one two three four"),
        ("host １０.２０.３０.４０ up", "ip", "１０.２０.３０.４０"),
        ("node 10 dot 20 dot 30 dot 40 up", "ip", "10 dot 20 dot 30 dot 40"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    spans = [(text[a:b], KINDS[k], plain) for a, b, k, plain in find_spans(text)]
    assert spans == [(source, kind, False)]


def test_prose_stays_clean():
    for text in ("grown at the lab, a dot on the plate", "one two three", "at 37 degrees. Dot by dot."):
        assert find_spans(text) == []


@pytest.mark.parametrize("between", [" ", "-", " -", "- ", " - ", ", "])
@pytest.mark.parametrize("before", ["call ", "ring: ", "zero. ", "(", ""])
def test_every_separator_of_spelled_digits(between, before):
    for items in ("five five five one two three four five six seven", "five 5 five 1 two 3 four 5 six 7",
                  "null cinq null cinq null cinq null cinq null cinq"):
        number = "+" + between.join(items.split())
        text = f"{before}{number}."
        assert [(text[a:b], KINDS[k]) for a, b, k, _ in find_spans(text)] == [(number, "phone")]


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write curator at strains.org now", "email", "curator at strains.org"),
        ("mail j.doe7 at lab.strains.org.", "email", "j.doe7 at lab.strains.org"),
        ("host one nine two dot one six eight dot one dot two up", "ip", "one nine two dot one six eight dot one dot two"),
        ("host 192 [dot] one six 8 [dot] zero [dot] 7 up", "ip", "192 [dot] one six 8 [dot] zero [dot] 7"),
        ("host one.two.three.four", "ip", "one.two.three.four"),
    ],
)
def test_plain_domains_and_spelled_parts(text, kind, source):
    assert [(text[a:b], KINDS[k]) for a, b, k, _ in find_spans(text)] == [(source, kind)]


def test_prose_around_at_and_dots_stays_clean():
    for text in (
        "available at strains.org", "look at www.strains.org", "see them at strains.org/list", "grown at 3.5 degrees",
        "One. Two. Three. Four. Five.", "it ended at noon.The next day", "one dot two dot three",
    ):
        assert find_spans(text) == []


def test_bare_at_needs_a_sign_of_an_address():
    clean = (
        "We met Thursday at example.org for lunch.", "The conference was held at fossa.io", "see Fig. 3 at cell.com",
        "Wir trafen uns Dienstag at example.org zum Essen", "Die Tagung fand at fossa.io statt",
        "Nous avons mangé jeudi at example.org ensemble", "La conférence eut lieu at fossa.io",
        "Nos vimos el jueves at example.org para comer", "La reunión fue at fossa.io", "contact us at example.org",
    )
    for text in clean:
        assert find_spans(text) == []
    for text, source in (
        ("reach curator at strains.org", "curator at strains.org"), ("Kontakt: mueller at strains.org", "mueller at strains.org"),
        ("écrivez à dupont at strains.org", "dupont at strains.org"), ("correo de perez at strains.org", "perez at strains.org"),
        ("ask ana_p at strains.org", "ana_p at strains.org"), ("ask curator [at] strains.org", "curator [at] strains.org"),
    ):
        assert [text[a:b] for a, b, _, _ in find_spans(text)] == [source]


def test_rows_and_masks(samples, edge_rows):
    rows = [*edge_rows, (20, "mail a@b.org or +1 (555) 010-9999 é 10.0.0.1")]
    out = {r["bacdive_id"]: r["found"] for r in find_private_data(samples(rows)).collect()}
    assert [f["kind"] for f in out[20]] == ["email", "phone", "ip"] and out[2] == []
    masked = mask_private_data(samples(rows)).filter("bacdive_id = 20").first()["masked_text"]
    assert masked == "mail [EMAIL] or [PHONE] é [IP]"
    assert mask_private_data(samples(rows)).count() == len(rows)
    assert find_private_data(samples([])).count() == 0
