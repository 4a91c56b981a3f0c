"""Samples that look like the header of the next frame."""

import numpy as np
import pytest

from changelens.llm import flac
from tests.llm.test_operators import bits_of, frame


def stream_of(*parts):
    """A stream of one verbatim frame for each list of samples."""
    frames = [frame(len(x), bits_of([(0, 1), (1, 6), (0, 1), *((v, 8) for v in x)]), i) for i, x in enumerate(parts)]
    return flac._stream(np.array(sum(parts, []), np.int8), frames)


def signed(data):
    return np.frombuffer(data, np.int8).tolist()


def imitation(n, subframe):
    """A header of frame 1 whose checksum fits, and what follows it."""
    head = b"\xff\xf8\x70\x02\x01" + (n - 1).to_bytes(2, "big")
    bits = subframe.ljust(256, "0")
    return head + bytes([flac.crc8(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")


NEGATIVE_SHIFT = bits_of([(0, 1), (32, 6), (0, 1), (5, 8), (3, 4), (-4, 5), (3, 4), (0, 2), (0, 4), (0, 4)]) + "1" * 100
WASTED = bits_of([(0, 1), (0, 6), (1, 1)]) + "0" * 12 + "1"


@pytest.mark.parametrize(
    "fake",
    [
        b"\xff\xf8\x00\x00\x01" + bytes(11),  # the reserved block size
        imitation(16, NEGATIVE_SHIFT),
        imitation(16, WASTED),
        imitation(65536, ""),  # more samples than frames have
    ],
)
def test_imitated_headers(fake):
    first = signed(b"ab" + fake + b"cd")
    second = list(range(16))
    other = [7] * 50
    streams = [stream_of(first, second), stream_of(other)]
    got = flac.decode(streams)
    assert got[0][0].tolist() == first + second and [n for *_, n in got[0][1]] == [len(first), 16]
    assert got[1][0].tolist() == other


def test_no_frame_has_more_samples_than_the_stream_says():
    s = stream_of(signed(imitation(65536, "")), list(range(16)))
    assert all(n <= flac.BLOCK for _, n, _ in flac._frame_starts(s, flac._headers(s)[2], flac._headers(s)[0]))
