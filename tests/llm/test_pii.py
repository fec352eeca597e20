import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from bedledger.llm import pii
from helpers import documents, needs_tables, odd_rows, table

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    spans = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                13 <= len(digits) <= 19 and pii.luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if fits:
                spans.append((kind, *m.span()))
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@ab%_\né", max_size=60))
def test_strict_rules_like_plain_patterns(text):
    assert pii.strict_spans(text) == plain_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@needs_tables
def test_all_texts_like_plain_patterns(spark):
    docs = table(spark, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.span_digest(pii.find_spans(docs, pii.train(docs))).collect():
        spans = plain_spans(texts[r.doc_id])
        told = pii.told(spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert set(told.split(",")) <= set(r.spans.split(","))


def test_the_trees_add_what_the_rules_miss_beside_each_other(spark):
    rng = random.Random(3)

    def card():
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(digits + d for d in "0123456789" if pii.luhn(digits + d))

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    rows = []
    for n in range(600):
        filler = " ".join(rng.choice(["alpha", "beta", "gamma", "4.0", "v1.2.3", "2001", "12-34"]) for _ in range(12))
        rows.append((n, f"{filler} {card()} {filler} {phone()} {filler} 10.{n % 250}.3.4 end a.{n}@mail.example.com x"))
    rows.append((9999, f"text {phone()} {card()} text"))
    model = pii.train(documents(spark, rows))
    (found,) = [r for r in pii.find_spans(documents(spark, rows), model).collect() if r.doc_id == 9999]
    assert not found.strict and {s.kind for s in found.added} == {"card", "phone"}
    clean = [r for r in pii.find_spans(documents(spark, [(1, "alpha 4.0 beta v1.2.3 in 2001 by 12-34 units")]), model).collect()]
    assert not clean[0].added
    (text,) = [r.text for r in pii.redacted(documents(spark, rows), model).where("doc_id = 9999").collect()]
    assert text == "text [PHONE] [CARD] text"


def test_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    model = pii.train(docs)
    found = pii.span_digest(pii.find_spans(docs, model)).collect()
    assert len(found) == len(rows) and all(r.spans == "" for r in found)
    kept = pii.redacted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert pii.find_spans(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_overlapping_spans_become_one():
    assert pii.redact("ab cd ef", [(0, 0, 5), (1, 3, 8)]) == "[EMAIL]"
    assert pii.redact("ab cd ef", [(0, 0, 2), (3, 6, 8)]) == "[EMAIL] cd [PHONE]"


def test_numbers_of_many_groups_are_proposed_whole():
    for number in ("06 12 34 56 78", "+33 1 23 45 67 89"):
        text = f"call {number} 4111111111111111 now"
        at = text.index(number)
        assert (3, at, at + len(number)) in pii.candidates(text)
    assert len(pii.candidates("1 " + "- " * 20_000 + "2")) == 0


def test_a_number_of_six_groups_beside_a_card_is_redacted(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = lambda: "+33 1 " + " ".join(digits(2) for _ in range(4))
    rows = [(n, f"alpha {phone()} beta 12 4111111111111111 gamma 4111111111111111 v1.2.3 by 12-34 and {phone()} x") for n in range(600)]
    rows.append((9999, f"text {phone()} 4111111111111111 text"))
    docs = documents(spark, rows)
    (text,) = [r.text for r in pii.redacted(docs, pii.train(docs)).where("doc_id = 9999").collect()]
    assert text == "text [PHONE] [CARD] text"


def test_national_numbers_and_written_out_addresses_are_found(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    national = lambda: f"({rng.randint(200, 999)}) 555-{digits(4)}"
    words = ["alpha", "beta", "gamma", "4.0", "v1.2.3", "2001", "12-34", "page 1200345", "no. 2024-11-05", "id 77 12 34"]
    # letters between the numbers: longer runs of digits are card numbers now and then
    filler = lambda n: " and ".join(rng.choice(words) for _ in range(n))
    rows = [(n, f"{filler(9)} call +1 {national()} or {filler(6)} mail joe.{digits(3)}@mail.example.com {filler(5)}") for n in range(700)]
    planted = []
    for n in range(1000, 1100):
        number, address = national(), f"ann.{digits(2)} (at) mail (dot) example (dot) org"
        text = f"{filler(7)} call {number} or {filler(4)} mail {address} {filler(3)}"
        planted.append((text.index(number), text.index(number) + len(number), text.index(address), text.index(address) + len(address)))
        rows.append((n, text))
    clean = [(n, filler(40)) for n in range(2000, 2100)]
    docs = documents(spark, rows + clean)
    model = pii.train(docs)
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.added} for r in pii.find_spans(docs, model).collect()}
    caught = [(("phone", a, b) in found[1000 + n]) + (("email", c, d) in found[1000 + n]) for n, (a, b, c, d) in enumerate(planted)]
    assert sum(caught) >= 0.9 * 2 * len(planted)
    assert not any(found[n] for n, _ in clean)


def test_labels_leave_out_what_rules_cannot_judge():
    text = "call +1 (743) 555-3824 now or (743) 555-3824 or joe (at) mail (dot) org, or ann@mail.org; page 2001 77 1234"
    labels = [(y, form) for _, y, form in pii.labelled_candidates(text)]
    assert {form for y, form in labels if y == 2} == {"phone (999) 999-9999", "email "}
    # parts of a strict span are no negatives; forms of disguised spans are dropped when all forms are known
    assert all("+" not in form for y, form in labels if y == 0)
    assert sum(y == 1 for y, _ in labels) == 2
