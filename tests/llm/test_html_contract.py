"""What is text of an article, and the names that count."""

import pytest

from shelfmark.llm import html_extraction
from shelfmark.llm.html_blocks import WIDTH, feature, leaf_blocks

FILL = "<p>A first sentence stands here. A second one follows it.</p>"
SHELL = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{}</article><footer>&copy; x.example</footer></body></html>"


@pytest.fixture(scope="module")
def field(spark):
    pages = [(i, f"http://x/{i}", SHELL.format(FILL * (1 + i % 4))) for i in range(40)]
    return html_extraction.train(spark.createDataFrame(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("inside, shown", [
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given. It is one.</p>", "Let x=1 be given. It is one."),
    ("<noscript><p>This paragraph needs no script. It stays.</p></noscript>", "This paragraph needs no script. It stays."),
    ("<svg><text>Words drawn in a figure. They stay.</text></svg>", "Words drawn in a figure. They stay."),
    ("<video><p>A film that can't be played here. It has a text.</p></video>", "A film that can't be played here. It has a text."),
    ("<object><canvas><p>A drawing by another way. It has a text.</p></canvas></object>", "A drawing by another way. It has a text."),
    ("<script>var a = '<p>no</p>';</script><style>p { x: y }</style><template><p>No text. Not at all.</p></template>", ""),
])
def test_only_scripts_styles_templates_and_titles_are_hidden(field, inside, shown):
    fill = "A first sentence stands here. A second one follows it."
    assert html_extraction.extract_text(SHELL.format(FILL + inside + FILL), field) == " ".join(x for x in (fill, shown, fill) if x)


def test_all_names_above_a_block_count():
    html = "".join(f'<div class="c{i} d{i}">' for i in range(200)) + "<article id='body'><p>Deep.</p></article>" + "<p>After.</p>"
    deep, after = leaf_blocks(html)
    names = [f"mark {k}{i}" for k in "cd" for i in range(200)]
    assert deep.marks == frozenset(map(feature, [*names, "mark body", "under article"])) and deep.tags == frozenset(map(feature, ["under div", "under p"]))
    assert after.marks == frozenset(map(feature, names)) and not after.in_mark and deep.in_mark
    seen, blind = next(html_extraction.block_features([deep])), next(html_extraction.block_features([deep], blind=True))
    assert deep.marks <= set(seen) and feature("under article") not in blind and max(seen) < WIDTH


def test_blocks_share_their_names():
    blocks = leaf_blocks("<div class='a b'>" + "<p>One.</p>" * 50 + "</div>")
    assert len({id(b.tags) for b in blocks}) == 1 and len({id(b.marks) for b in blocks}) == 1
