"""Mined URL rules over whole token sets."""

from umbral.llm.url_rules import ALLOW, BLOCK, Mining, mine, url_tokens


def test_counts_are_over_whole_urls(llm):
    """The token that tells least is in every rule's count, however many tokens tell more."""
    more = "/".join(chr(97 + k) * 3 for k in range(9))
    rows = [(f"http://x.com/common/{more}/{k % 4}{'1' * (k % 3)}", BLOCK) for k in range(40)]
    rows += [(f"http://y.com/common/{'z' * (1 + k % 5)}", ALLOW) for k in range(40)] + [(f"http://x.com/{chr(97 + k % 9) * 3}", ALLOW) for k in range(18)]
    rules = mine(llm.createDataFrame(rows, "url string, verdict string"), "url", "verdict", Mining(support=0.05))
    assert rules
    for r in rules:
        fits = [v for u, v in rows if r.tokens <= url_tokens(u)]
        assert abs(fits.count(r.verdict) / len(fits) - r.confidence) < 1e-9 and r.confidence >= 0.9
        assert abs(fits.count(r.verdict) / len(rows) - r.support) < 1e-9
    assert all(not (a.verdict == b.verdict and a.tokens < b.tokens and a.confidence >= b.confidence) for a in rules for b in rules)
