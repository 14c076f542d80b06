"""What the driver holds while the quality classifier is fitted."""

import tracemalloc

import numpy as np
import pytest

from barloom.llm import quality


def texts(n: int, words: int) -> list[str]:
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (n, words, 7)).astype(np.uint8)
    letters[:, :, 6] = ord(" ")
    return [x.tobytes().decode() for x in letters]


def rows_of(text: str) -> list[np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return [rows for rows, _, _ in quality.groups(data, np.array([0, len(data)]))]


def bag(text: str) -> dict[int, np.float32]:
    parts, total = rows_of(text), {}
    for rows in parts:
        for r in rows.tolist():
            total[r] = total.get(r, 0.0) + 1 / len(rows) / len(parts)
    return {r: np.float32(v) for r, v in total.items()}


@pytest.mark.parametrize("places", [2**16, 2])
def test_packed_bags_are_the_bags(places, monkeypatch):
    monkeypatch.setattr(quality, "PLACES", places)
    some = [*texts(3, 300), "", "a", "a a a a", "é\n" * 50]
    bags = quality.Bags(some)
    assert len(bags) == len(some) and (len(bags.plain) > 0) == (places == 2)
    for i, text in enumerate(some):
        (own, share), want = bags.get(i), bag(text)
        assert own.tolist() == sorted(want) and share.dtype == np.float32
        assert np.allclose(share, [want[r] for r in own.tolist()], rtol=1e-6)


def test_fit_holds_few_bytes_for_a_row(monkeypatch):
    """All texts are held at once, so what one row of one text costs decides what the driver needs."""
    monkeypatch.setattr(quality, "STEPS", 1)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    some = [(t, i % 2) for i, t in enumerate(texts(250, 1_500))]
    held = sum(len(np.unique(np.concatenate(rows_of(t)))) for t, _ in some)
    tracemalloc.start()
    quality.fit(some, {0: 125, 1: 125})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held > 4_000_000 and peak < 20_000_000 + 6 * held
