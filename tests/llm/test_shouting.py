"""Words that end in two exclamation marks, before every kind of white space."""

import pytest

from lodestack.llm import quality_rules

from .test_llm_operators import frame, words


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\r", "\r\n", "\x0b", "\x0c"])
def test_shouted_words_count_before_all_white_space(spark, space):
    text = space.join(w + "!!" if k % 2 else w for k, w in enumerate(words(1, 80)))
    assert quality_rules.Text(text.encode()).n_shouted == 40
    df = frame(spark, [text, text.replace("!!", "")])
    assert [r.kept for r in sorted(quality_rules.quality_report(df).collect())] == [False, True]
    assert [r.doc_id for r in quality_rules.quality_filter(df).collect()] == [1]
