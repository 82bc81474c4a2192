"""Main text of pages: nothing but the content of skipped elements is dropped."""

import pytest

from weftgraph.llm import html_text


def texts(page):
    return [b.text for b in html_text.leaf_blocks(page)]


@pytest.mark.parametrize("page, want", [
    ('<p>a</p><svg class="icon"/><p>b</p>', ["a", "b"]),
    ("<p>a <math/> b</p><p>c</p>", ["a b", "c"]),
    ('<p>a</p><svg class="icon"/><p>b</p><svg><text>no</text></svg><p>c</p>', ["a", "b", "c"]),
    ("<p>a</p><svg><svg><text>no</text></svg><text>no</text><svg/></svg><p>b</p>", ["a", "b"]),
    ("<svg><title>no</title><style/><path d='M0'/></svg><p>a</p>", ["a"]),
    ("<template><p>no</p><template>no</template><script>'</template>'</script><p>no</p></template><p>a</p>", ["a"]),
    ("<p>a</p><object data=x><p>fallback</p><object>inner</object> rest</object><p>b</p>", ["a", "fallback", "inner rest", "b"]),
    ("<p>a</p><object data=x><param name=y><p>b</p>", ["a", "b"]),
    ("<p>so <math><mi>E</mi> <mo>=</mo> <mi>m</mi></math> holds</p>", ["so E = m holds"]),
    ("<p>a</p><template><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg viewBox='0 0'><path d=z><p>b</p><svg><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><noscript><p>b</p>", ["a", "b"]), ("<noscript><img></noscript><p>a</p>", ["a"]),
    ("<head><title>no</title><body><p>a</p><head><title>no</title></head><p>b</p>", ["a", "b"]),
    ("<p>a</p><!-- </svg> --><svg><!-- </svg> --><text>no</text></svg ><p>b</p></svg>", ["a", "b"]),
    ("<p>a</p><script>var x = '<svg>'</script><p>b</p><style>no", ["a", "b"])])
def test_text_after_and_in_elements(page, want):
    assert texts(page) == want


def test_many_elements_that_are_not_closed():
    assert texts("<svg><p>word</p>" * 20_000) == ["word"] * 20_000
    assert texts("<svg>" * 20_000 + "no" + "</svg>" * 20_000 + "<p>a</p>") == ["a"]
    assert texts("<p>a</p>" + "<svg><style>" * 20_000) == ["a"]
