"""Training reads long pages to their end."""

from shelfmark.llm.html_extraction import MARKS, _both_views


def test_a_long_training_page_is_read_to_its_footer():
    article = "".join(f"<p>Sentence {i} of the long story.</p>" for i in range(600))
    views = _both_views(f"<html><body><article>{article}</article><footer><p>Terms of use</p></footer></body></html>", MARKS)
    assert [y for _, y in views] == [[1] * 600 + [0]] * 2
    assert all(len(x) == 601 for x, _ in views)
