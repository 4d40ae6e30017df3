"""Words of a text: the same at every call, whatever white space a buffer ends in."""

import pyarrow as pa
import pytest

from annolith.llm import shared


@pytest.mark.parametrize("text", ["  ", "a b  ", "a b ", " \n ", "a\u2003\u00a0", "", "x\ty\r\n"])
def test_white_space_at_the_end_of_a_buffer(text):
    want = text.split()
    for _ in range(2000):
        codes, words, lens = shared.split_words(pa.array(["q r", None, text]).fill_null(""))
        assert lens.tolist() == [2, 0, len(want)]
        assert words.take(pa.array(codes)).to_pylist() == ["q", "r", *want]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
