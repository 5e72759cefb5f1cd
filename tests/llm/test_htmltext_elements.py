import pytest

from weftgraph.llm.htmltext import blocks


@pytest.mark.parametrize("odd", ['<svg width="1"/>', "<svg>", "<math/>", "<button>", "<select>", "<object>", "<canvas>", "<button-bar>", "<template-part>", "<title-line>", "<svg-icon>"])
def test_no_element_but_raw_text_swallows_what_follows(odd):
    got = [b[0] for b in blocks(f"<article><p>one</p>{odd}<p>two</p><p>three</p></article>")]
    assert got == ["one", "two", "three"]


def test_formulas_and_fallbacks_are_text_and_drawings_are_not():
    page = "<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><object>fallback</object><svg><text>no</text></svg><p>a <button>b</button> c</p><script>var x</script>"
    found = blocks(page)
    assert [b[0] for b in found] == ["let x=1 be", "fallback", "a", "b", "c"]
    assert "<p" in found[-1][1]
    assert blocks("<p>a</p><textarea>b<p>c") == blocks("<p>a</p>")


def test_many_drawings_without_an_end_are_read_in_linear_time():
    from time import perf_counter

    start = perf_counter()
    assert [b[0] for b in blocks("<p>a</p>" + "<svg>" * 200_000 + "<p>b</p>")] == ["a", "b"]
    assert [b[0] for b in blocks("<p>a</p><svg>no</SVG ><p>b</p><svg>c")] == ["a", "b", "c"]
    assert perf_counter() - start < 20
