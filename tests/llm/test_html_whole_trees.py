"""Trees of pages are compared whole, however deep or wide."""

import pytest

from millrace.llm import html_extract


def extracted(sources):
    wrapper = html_extract.align([html_extract.page_wrapper(html_extract.parse(s), s) for s in sources])
    wrapper = html_extract.Wrapper.load(wrapper.dump()).settled()
    return [html_extract.extract(s, wrapper).split("\n") for s in sources]


@pytest.mark.parametrize("depth", [10, 45, 390])
def test_deep_nesting(depth):
    """Text below any depth stays where it varies, and goes where it is template."""
    sources = [f"<body><h1>Head</h1><div>about {i}</div>{'<div class=d>' * depth}<section>story {i}</section><ul>fixed</ul>{'</div>' * depth}</body>" for i in range(4)]
    assert extracted(sources) == [[f"about {i}", f"story {i}"] for i in range(4)]


def test_many_runs_of_siblings():
    """A template block after more than 64 runs goes, and what varies there stays."""
    sources = []
    for i in range(4):
        body = "".join(f"<h2>title {i} {k}</h2><p>passage {i} {k}</p>" for k in range(45 + i))
        sources.append(f"<body><div>{body}<section>story {i}</section><ul>fixed</ul></div></body>")
    for i, text in enumerate(extracted(sources)):
        assert f"story {i}" in text and f"passage {i} 44" in text and "fixed" not in text


def test_one_off_siblings_of_a_host():
    """Siblings that each page has for itself don't push a template block out of the wrapper."""
    sources = [f"<body><div><section class={chr(97 + i % 26)}x{chr(97 + i // 26)}>story {i}</section><ul>fixed</ul></div></body>" for i in range(80)]
    assert extracted(sources) == [[f"story {i}"] for i in range(80)]


def test_pages_without_elements_leave_the_template(spark):
    """Null, empty and bare texts among a host's pages don't make its template content."""
    rows = [(i, "http://a.test/x", f"<body><div><section>story {i}</section><ul>fixed</ul></div></body>") for i in range(4)]
    rows += [(4, "http://a.test/x", None), (5, "http://a.test/x", ""), (6, "http://a.test/x", "bare")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert found == {0: "story 0", 1: "story 1", 2: "story 2", 3: "story 3", 4: "", 5: "", 6: "bare"}
