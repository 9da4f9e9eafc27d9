"""Facts and properties of transform, codes, distances and energy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.functions import energy, transform
from stratavec.functions.spec import ONE_BIT, TWO_BIT, IndexSpec, UnsupportedLayout, rademacher
from stratavec.sources import interop


def test_signs_are_those_of_the_generator():
    known = "+-+--+-++-+----+-++++---++-+--+---+---+-+++-+-++----+--++-++-+--"
    assert "".join("+" if s > 0 else "-" for s in rademacher(64)) == known
    assert (rademacher(128)[:64] == rademacher(64)).all()


def test_energy_of_diagonal_weights():
    assert np.allclose(energy.cumulative(np.diag([2, 1, 0.5, 0.0])), [0.7619, 0.9523, 1, 1], atol=1e-3)
    w = np.linalg.qr(np.random.default_rng(0).standard_normal((6, 6)))[0] @ np.diag([3, 2, 1, 0.5, 0.2, 0.1])
    assert np.allclose(energy.cumulative(w, "exact"), energy.cumulative(w), atol=1e-3)
    assert energy.active_tier(np.array([0.5, 0.8, 0.95]), 0.9) == 2
    assert energy.active_tier(np.array([0.5, 0.8]), 0.9) == 0
    with pytest.raises(ValueError):
        energy.active_tier(np.array([1.0]), 0)


@pytest.mark.parametrize(("dim", "tiers"), [(64, (64,)), (64, (16, 32, 48, 64)), (128, (64, 128)), (12, (12,)), (96, (64, 96)), (33, (16, 33)), (384, (64, 128, 256, 384))])
def test_rotation_is_orthogonal_and_invertible(dim, tiers):
    spec = IndexSpec(dim, tiers)
    x = np.random.default_rng(1).standard_normal((5, dim))
    z = transform.rotate(x, spec)
    assert np.allclose(np.linalg.norm(z, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(transform.back_project(z, spec), x)


def test_words_of_sub_word_tiers():
    spec = IndexSpec(33, (16, 33))
    assert spec.words == [(0, 0, 16), (1, 16, 33)] and spec.code_columns() == ["w0", "w1"] and spec.code_columns(0) == ["w0"]
    bits = np.random.default_rng(2).integers(0, 2, (7, 33)).astype(bool)
    assert (transform.unpack_words(transform.pack_words(bits, spec), spec) == bits).all()


def test_two_bit_active_share():
    z = np.random.default_rng(3).standard_normal((4, 64))
    assert ((np.abs(z) >= transform.threshold(z)[:, None]).sum(1) == 52).all()


@given(st.lists(st.floats(-2, 2, width=32), min_size=64, max_size=64), st.lists(st.floats(-2, 2, width=32), min_size=64, max_size=64))
@settings(max_examples=30, deadline=None)
def test_code_distances_are_squared_distances(a, b):
    for mode in (ONE_BIT, TWO_BIT):
        spec = IndexSpec(64, (64,), mode)
        z = transform.rotate(np.array([a, b], np.float32), spec)
        c = transform.codes(z, spec)
        if mode == ONE_BIT:
            v = np.where(transform.unpack_words([c["w0"]], spec), 1, -1)
            d = int(np.bitwise_count((c["w0"][:1] ^ c["w0"][1:]).view(np.uint64))[0])
            assert 4 * d == ((v[0] - v[1]) ** 2).sum()
        else:
            v = transform.unpack_words([c["m0"]], spec) * np.where(transform.unpack_words([c["s0"]], spec), 1, -1)
            s, m = c["s0"].view(np.uint64), c["m0"].view(np.uint64)
            d = 4 * int(np.bitwise_count(m[0] & m[1] & (s[0] ^ s[1]))) + int(np.bitwise_count(m[0] ^ m[1]))
            assert d == ((v[0] - v[1]) ** 2).sum()


def test_hamming_follows_the_angle():
    rng, spec = np.random.default_rng(4), IndexSpec(512, (512,))
    x = rng.standard_normal((200, 512))
    y = x + 0.7 * rng.standard_normal((200, 512))
    angle = np.arccos((x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1))
    bits = (transform.rotate(x, spec) >= 0) != (transform.rotate(y, spec) >= 0)
    assert abs(bits.mean() - angle.mean() / np.pi) < 0.01


def test_layouts_are_checked():
    for dim, tiers in ((64, (64, 32)), (64, (65,)), (64, (0, 64)), (9, tuple(range(1, 10)))):
        with pytest.raises(UnsupportedLayout):
            IndexSpec(dim, tiers)
    with pytest.raises(UnsupportedLayout):
        IndexSpec(8, (8,), 7)


def test_codecs():
    spec = IndexSpec(128, (64, 128), TWO_BIT, False, 3, 1737400)
    assert len(interop.header_bytes(spec, 9)) == 64
    back, n = interop.parse_header(interop.header_bytes(spec, 9))
    assert (back, n) == (spec, 9)
    with pytest.raises(UnsupportedLayout):
        interop.parse_header(b"x" * 64)
    x = np.random.default_rng(5).standard_normal((6, 128)).astype(np.float32)
    assert (interop.parse_vecs(interop.vecs_bytes(x)) == x).all() and interop.parse_vecs(b"").shape == (0, 0)
    whole = np.arange(12).reshape(3, 4)
    assert (interop.parse_vecs(interop.vecs_bytes(whole), False) == whole).all()
    assert (interop.parse_npy(interop.npy_bytes(x)) == x).all()
    assert np.allclose(interop.parse_half(interop.half_bytes(x), 128), transform.to_half(x))
    c = transform.codes(transform.rotate(x, spec), spec)
    tier = interop.tier_bytes([c["s0"], c["m0"]], TWO_BIT)
    assert all((a == b).all() for a, b in zip(interop.parse_tier(tier, 64, TWO_BIT), (c["s0"], c["m0"]), strict=True))
    log = interop.log_bytes([(1, 5, x[0]), (2, 5, None), (1, 6, x[1])])
    assert [(s, k, i) for s, k, i, _ in interop.parse_log(log, 128)] == [(1, 1, 5), (2, 2, 5), (3, 1, 6)]
    assert len(list(interop.parse_log(log[:-3], 128))) == 2
    dim, rows = interop.parse_dump(interop.dump_bytes([(7, x[0]), (8, x[1])], 128))
    assert dim == 128 and [i for i, _ in rows] == [7, 8] and np.allclose(rows[1][1], x[1])
