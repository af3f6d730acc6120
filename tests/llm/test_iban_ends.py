"""Account numbers before capitals and digits, and words in any letter case."""

import pytest

from lodestack.llm import pii

GERMAN, SPACED = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
BRITISH = "GB82 WEST 1234 5698 7654 32"


def added(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text, pii.automaton()) if k >= 4]


@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " BIC X", " 2024", " X", ", BIC", " and", " BIC COBADEFFXXX 2024 EUR 100"])
@pytest.mark.parametrize("iban", [GERMAN, SPACED, BRITISH])
def test_iban_ends_where_its_country_says(iban, after):
    assert added(f"IBAN {iban}{after}") == [("iban", iban)]


def test_iban_of_an_unknown_country_ends_at_a_blank():
    body = "123456789012345"
    check = 98 - int(body + "33330" + "0") % 97  # X is 33
    code = f"XX{check:02d}{body}"
    assert added(f"IBAN {code} BIC COBADEFFXXX") == [("iban", code)]
    assert added("IBAN DE00 3704 0044 0532 0130 00 BIC X") == []


@pytest.mark.parametrize("cue", ["Tax ID", "tax id", "TAX ID", "tAX iD", "Account No", "pAsSpOrT"])
def test_cues_in_any_case(cue):
    assert added(f"{cue}: 123456789") == [("account", "123456789")]


def test_iban_and_secret_cues_in_any_case():
    assert added(f"Iban {GERMAN}") == added(f"iBAN {GERMAN}") == [("iban", GERMAN)]
    assert added("Api_Key = 9233A8ECF7C5B09FE594") == [("secret", "9233A8ECF7C5B09FE594")]
