"""Names and numbers of kinds that are on no list of the module."""

from __future__ import annotations

import itertools

from codeloom.llm.pii import GIVEN_NAMES, find_spans, mask_text

NAMES = ["Zbigniew Kowalczyk", "Kwame Mensah", "Oluwaseun Adeyemi", "Ayumi Tanaka", "Deepika Raghunathan", "Thandiwe Nkosi", "Siobhan Gallagher", "Ngozi Okafor", "Dmitri Volkov", "Leilani Kahale"]
FRAMES = [
    "{} said the pump was late.", "My neighbour {} asked twice.", "We heard that {}, who works nights, left early.", "I am {} and I live here.", "According to {} nothing changed.", "Yesterday {} explained it to the board.",
    "Her brother {} wrote to us.", "They spoke to {} after lunch.", "{} lives near the depot.", "In the end {} agreed."]


def test_names_off_the_list():
    cases = [(f, n) for f, n in itertools.product(FRAMES, NAMES) if not set(n.split()) & set(GIVEN_NAMES)]
    found = sum(any(f.format(n)[a:b] == n and k == "NAME" for a, b, k, _ in find_spans(f.format(n))) for f, n in cases)
    assert len(cases) == 100 and found >= 0.9 * len(cases), found


def test_no_names():
    for t in ("Port Essery said no.", "The Housing Desk asked us.", "Tallow Hill was closed.", "My neighbour asked twice.", "According to Norhaven Council nothing changed.", "In March Street nobody lives.", "The Meridian Test said little."):
        assert not [x for x in find_spans(t) if x[2] == "NAME"], t


def test_validators_and_context_confirm():
    assert mask_text("It reads 4111 1111 1111 1111.") == "It reads [IDNUM]." and mask_text("It reads 4111 1111 1111 1112.") == "It reads 4111 1111 1111 1112."
    assert mask_text("IBAN GB82 WEST 1234 5698 7654 32 please") == "IBAN [IDNUM] please"
    assert mask_text("Call me on 612 345 678.") == "Call me on [PHONE]." and "[PHONE]" in mask_text("手機13812345678 可以找我")
    assert mask_text("They spent 612 345 678 in all.") == "They spent 612 345 678 in all."
