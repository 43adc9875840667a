import pytest

from scriptoria.llm import pii


@pytest.mark.parametrize("address", ["jane.doe at example.com", "jane.doe [at] example.com", "jane.doe(AT)example.com", "jane.doe {at} example dot com"])
def test_a_spelled_address_is_proposed_whatever_else_the_text_holds(address):
    found = []
    for rest in ("", " An anecdote follows.", " Nothing follows."):
        text = f"write to {address}{rest}"
        found.append([(k, text[lo:hi]) for k, lo, hi in pii.candidates(text) if k == "email"])
    assert any(x.startswith(address) for _, x in found[0])
    assert all(len(f) == 1 and f[0][1].startswith(address) for f in found)
