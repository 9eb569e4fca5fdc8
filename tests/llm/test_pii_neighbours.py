"""Card and account numbers next to other digits and words."""

import pytest

from terraspark.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize(
    "text,value,kind",
    [(t, t[t.index("4111") :][:19], "card") for t in (f"{CARD} 123", f"{CARD} 12/25", "4111-1111-1111-1111 05/27", f"2 {CARD}", f"{CARD} 2026", f"12 35 {CARD}", f"{CARD} 12 34 56 78", f"{CARD} 05/2027", "4111-1111-1111-1111-123")]
    + [(f"{IBAN} BIC", IBAN, "iban"), ("DE89370400440532013000 500 EUR", "DE89370400440532013000", "iban"), (f"AB12 {IBAN} EUR", IBAN, "iban"), (f"{IBAN} GB82 WEST 1234 5698 7654 32", IBAN, "iban")],
)
def test_numbers_with_neighbours(text, value, kind):
    f = pii.Feistel(b"k")
    new, kinds = pii.pseudonymise_text(text.encode(), f, {})
    assert kinds[kind] >= 1 and value not in new.decode() and len(new) == len(text)
    at = text.index(value)
    assert new.decode()[:at] == text[:at]
    if kinds[kind] == 1:
        assert new.decode()[at + len(value) :] == text[at + len(value) :]


def test_two_cards_in_a_row():
    new, kinds = pii.pseudonymise_text(f"{CARD} 5500 0000 0000 0004 9".encode(), pii.Feistel(b"k"), {})
    assert kinds == {"card": 2} and b"4111" not in new[:4] and not new.startswith(b"5500", 20)


def test_other_kinds_after_a_run_of_digits():
    text = "12345 67890 12346 123-45-6789 and 1234567 1234567 1985-02-28"
    new, kinds = pii.pseudonymise_text(text.encode(), pii.Feistel(b"k"), {})
    assert kinds["ssn"] == 1 and kinds["date"] == 1


def test_long_runs_of_groups_take_linear_time():
    raw = b"10 20 30 47 " * 50_000
    assert sum(1 for _ in pii.candidates(raw + CARD.encode())) >= 1
