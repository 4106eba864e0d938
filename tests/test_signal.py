import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from squigspark.functions import bases
from squigspark.operators import dtw, events, mapping, reference, segments
from squigspark.options import MapOptions


def plateaus():
    levels = [80, 100, 70, 110, 90, 60]
    return np.array([v + ((7 * j) % 5 - 2) * 0.5 for v in levels for j in range(10)], dtype=np.float32), levels


@pytest.mark.parametrize("opt", [events.DNA, events.RNA])
def test_events_of_plateaus(opt):
    x, levels = plateaus()
    e = events.detect(x, opt)
    assert e["start"].tolist() == [0, 10, 20, 30, 40, 50]
    assert e["mean"].tolist() == levels
    assert e["length"].tolist() == [10] * 6


def test_events_of_little():
    assert len(events.detect(np.zeros(0))["start"]) == 0
    assert events.detect(np.ones(3))["length"].tolist() == [3]


def stepwise_peaks(short, long, opt):
    """Both detectors by their rules, one sample at a time, in single precision."""
    inf, rise = np.float32(np.inf), np.float32(opt.peak_height)
    level, width = [np.float32(opt.short_threshold), np.float32(opt.long_threshold)], [opt.short_width, opt.long_width]
    value, state, quiet, out = [short, long], [(-1, inf, False)] * 2, 0, []
    for i in range(1, len(short)):
        for which in (0, 1):
            if which and i <= quiet:
                continue
            v, (top, peak, fallen) = value[which][i], state[which]
            if top < 0:
                state[which] = (-1, v, False) if v < peak else (i, v, False) if v - peak > rise else state[which]
                continue
            top, peak = (i, v) if v > peak else (top, peak)
            clear = peak > level[which]
            if clear and not which:
                quiet, state[1] = top + width[0], (-1, inf, False)
            fallen = fallen or clear and peak - v > rise
            state[which] = (top, peak, fallen)
            if fallen and i - top > width[which] // 2:
                out.append(top)
                state[which] = (-1, v, False)
    return out


@pytest.mark.parametrize("opt", [events.DNA, events.RNA])
def test_boundaries_against_single_steps(opt):
    rng = np.random.default_rng(4)
    many = 0
    for _ in range(600):
        n, kind = int(rng.integers(0, 120)), int(rng.integers(0, 4))
        if kind == 0:
            short, long = rng.integers(0, 4, n) * 0.7, rng.integers(0, 4, n) * 4.0
        elif kind == 1:
            short, long = np.abs(rng.normal(1, 1, n)), np.abs(rng.normal(8, 4, n))
        else:
            short, long = np.abs(np.cumsum(rng.normal(0, 0.4, n))), np.abs(np.cumsum(rng.normal(0, 3, n)))
            short, long = (short, long) if kind == 2 else (np.round(short, 1), np.round(long))
        short, long = short.astype(np.float32), long.astype(np.float32)
        want = stepwise_peaks(short, long, opt)
        assert events.find_boundaries(short, long, opt) == want
        many += len(want)
    assert many > 1000


def test_statistic_against_a_loop():
    x = np.random.default_rng(0).normal(100, 10, 60).astype(np.float32)
    total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    squares = np.concatenate([[0], np.cumsum(x.astype(np.float64) ** 2)])
    got = events.tstat(total, squares, 60, 6)
    for i in range(60):
        want = 0.0
        if 6 <= i <= 54:
            a, b = x[i - 6 : i].astype(float), x[i : i + 6].astype(float)
            want = abs(b.mean() - a.mean()) / np.sqrt(max(a.var() + b.var(), 1e-38) / 6)
        assert got[i] == pytest.approx(want, rel=2e-3)


def test_low_plateau():
    x = np.concatenate([np.full(600, 100.0), np.full(400, 60.0), np.full(600, 140.0)]).astype(np.float32)
    opt = segments.PlateauOptions(scale=0.5, seg_dist=15, window=20, most=2000, least=20)
    got = segments.low_plateau(x, opt)
    t = np.array([x[i : i + 20].mean() for i in range(len(x) - 20)])
    low = np.flatnonzero(t < t.mean() - 0.5 * t.std())
    assert got == (low[0] + 9, low[-1] + 9)
    assert segments.low_plateau(x[:10], opt) == (-1, -1)
    assert segments.low_plateau(np.full(100, 5.0, np.float32), opt) == (0, 0)


def test_band_segments():
    opt = segments.BandOptions(corrector=5, seg_dist=2, window=6, stall_len=1.0, error=1)
    x = np.array([0] * 3 + [5] * 8 + [0] * 4 + [5] * 8 + [0] * 4)
    assert segments.band_segments(x, 1, 9, opt) == [(3, 11), (15, 23)]
    assert segments.band_segments(x[:11], 1, 9, opt) == []  # still open at the end
    assert segments.band_segments(np.zeros(0), 1, 9, opt) == []


def stepwise_band(inside, opt):
    """Runs sample by sample."""
    out, start, length, spent, last_out, width = [], None, 0, 0, 0, opt.corrector
    for i, ok in enumerate(inside):
        width += ok
        if start is None and not ok:
            continue
        if start is None:
            start, length, spent = i, 0, 0
        if not ok and spent >= opt.error:
            end = i - last_out
            if length >= opt.window or not out and length >= opt.window * opt.stall_len:
                out = [*out[:-1], (out[-1][0], end)] if out and start - out[-1][1] < opt.seg_dist else [*out, (start, end)]
            start, last_out = None, 0
            continue
        length, spent, last_out = length + 1, spent + (not ok), 0 if ok else last_out + 1
        spent -= length >= max(opt.window, width) and length % width == 0
    return out


def test_band_segments_against_single_steps():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rng.integers(0, 150))
        inside = rng.random(n) < rng.random()
        inside = np.repeat(inside, rng.integers(1, 9, n)) if n % 2 else inside
        opt = segments.BandOptions(int(rng.integers(1, 12)), int(rng.integers(0, 9)), int(rng.integers(1, 12)), float(rng.choice([0.25, 0.5, 1.0])), int(rng.integers(0, 25)))
        assert segments.band_segments(inside * 5.0, 1, 9, opt) == stepwise_band(inside.tolist(), opt)


def sequential(x, y, subsequence):
    n, m = len(x), len(y)
    c = np.zeros((n, m), np.float32)
    for i in range(n):
        for j in range(m):
            d = abs(np.float32(x[i]) - np.float32(y[j]))
            if i == 0:
                c[i, j] = d if subsequence or j == 0 else c[i, j - 1] + d
            elif j == 0:
                c[i, j] = c[i - 1, j] + d
            else:
                c[i, j] = d + min(c[i - 1, j - 1], c[i, j - 1], c[i - 1, j])
    return c


values = st.lists(st.integers(0, 4).map(float), min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(values, values, st.booleans())
def test_kernel_matrix_and_starts(x, y, subsequence):
    want = sequential(x, y, subsequence)
    assert np.array_equal(dtw.cost_matrix(np.array(x), np.array(y), subsequence), want)
    rows, starts = dtw.last_row(np.array([x, x[::-1]]), np.array(y), subsequence)
    assert np.array_equal(rows[0], want[-1])
    for j in range(len(y)):
        assert starts[0][j] == dtw.warp_path(want, j, subsequence)[0][1]


def test_path_and_maps():
    x, y = [1, 2, 3, 2], [0, 1, 1.5, 3, 5, 1, 2, 3, 2, 0]
    path = dtw.warp_path(dtw.cost_matrix(np.array(x), np.array(y)), 8)
    assert path == [(0, 5), (1, 6), (2, 7), (3, 8)]
    assert dtw.base_map(path) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert dtw.base_map([(0, 4), (1, 4), (1, 5), (2, 6)]) == [(0, 1), (-1, -1), (2, 2)]
    start, length = np.array([0, 10, 20]), np.array([10, 10, 5])
    assert dtw.signal_string([(0, 1), (-1, -1), (2, 2)], start, length, 0) == "20,1D5,"
    assert dtw.signal_string([(0, 0), (2, 2)], start, length, 0) == "10,10I5,"


def test_self_distance_is_zero():
    x = np.random.default_rng(1).normal(size=30)
    rows, starts = dtw.last_row(x[None], x)
    assert rows[0][-1] == 0 and starts[0][-1] == 0


def test_query_start_after_adaptor_and_tail():
    rng = np.random.default_rng(0)
    parts = [(500, 100), (3000, 50), (600, 80), (4000, 100)]
    x = np.concatenate([rng.normal(v, 1, n) for n, v in parts]).astype(np.float32)
    opt = segments.PlateauOptions(scale=0.5, seg_dist=50, window=100, most=10000, least=1000)
    starts = np.arange(0, len(x), 20)
    at = segments.query_start(x, x, starts, opt)
    assert 4050 <= starts[at] <= 4300
    assert segments.query_start(x[:50], x[:50], starts, opt) == -1
    assert segments.query_start(x[:3600], x[:3600], starts[:180], opt) == -1  # the tail has no end


def test_chunk_minima_and_ties():
    row = np.array([[8, 4, 2.5, 1.5, 3.5, 3.5, 1, 1, 0, 2]], dtype=np.float32)
    least, at = dtw.chunk_minima(row, 4)
    assert least.tolist() == [[1.5, 1, 0]] and at.tolist() == [[3, 6, 8]]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2).map(float), min_size=2, max_size=6), min_size=1, max_size=4), st.lists(st.lists(st.integers(0, 2).map(float), min_size=1, max_size=14), min_size=1, max_size=4))
def test_best_candidates_against_sorting(queries, refs):
    """Of equal scores the later reference and chunk rank first."""
    made = [{"levels": np.array(y, np.float32), "seq": 2 * i, "ref_idx": i, "strand": "+", "name": str(i), "ref_len": len(y), "seq_len": len(y), "st_offset": 0} for i, y in enumerate(refs)]
    for x, got in zip(queries, mapping.align([np.array(q) for q in queries], made, MapOptions()), strict=True):
        want = []
        for r in made:
            row = sequential(x, r["levels"], True)[-1]
            n = len(x)
            for c in range(0, len(row), n):
                want.append((float(row[c : c + n].min()), -((r["seq"] << 32) + c // n), c + int(row[c : c + n].argmin())))
        want = sorted(want)[:5]
        assert [(h["score"], -h["seq"], h["pos_end"]) for h in got] == want
        cost = sequential(x, made[got[0]["ref_idx"]]["levels"], True)
        assert got[0]["pos_st"] == dtw.warp_path(cost, got[0]["pos_end"])[0][1]


def test_first_events_follow_from_a_first_part():
    rng = np.random.default_rng(11)
    for opt in (events.DNA, events.RNA):
        for noise in (0.0, 0.3, 4.0):
            x = np.repeat(rng.normal(90, 15, 900), rng.integers(1, 30, 900)).astype(np.float32)
            x += rng.normal(0, noise, len(x)).astype(np.float32)
            whole = events.detect(x, opt)
            for most in (1, 25, 310, 10_000):
                assert all(np.array_equal(whole[c][:most], v) for c, v in events.detect(x, opt, most).items())


def test_joined_references_give_what_each_gives():
    rng = np.random.default_rng(12)
    refs = [{"seq": i, "ref_idx": i, "strand": "+", "name": f"n{i}", "ref_len": n, "seq_len": n + 4, "st_offset": 0, "levels": rng.integers(-3, 4, n).astype(np.float32)} for i, n in enumerate([1, 5, 40, 3, 200, 7, 64])]
    refs[3]["levels"][:] = np.nan
    queries = [rng.integers(-3, 4, n).astype(np.float32) for n in (6, 30, 30, 1, 45)]
    found, widths = mapping.align(queries, refs, mapping.MapOptions()), [len(y) for y, _ in mapping._joined(refs, mapping.MapOptions())]
    assert widths == [48, 3, 273]  # end to end, but for the one that isn't finite
    for q, got in zip(queries, found, strict=True):
        want = []
        for ref in refs:
            row = dtw.cost_matrix(q, ref["levels"])[-1]
            least, at = dtw.chunk_minima(row[None], len(q))
            want += [(float(v), (ref["seq"] << 32) + c, int(e)) for c, (v, e) in enumerate(zip(least[0], at[0], strict=True)) if np.isfinite(v)]
        assert [(c["score"], c["seq"], c["pos_end"]) for c in got] == sorted(want, key=lambda w: (w[0], -w[1]))[:5]


def test_reads_and_letters_are_held_some_at_a_time(monkeypatch):
    monkeypatch.setattr(reference, "LETTERS_HELD", 10)
    texts = ["ACGT", None, "", "A" * 25, "CC", "GGGGGGGG", "T"]
    parts = list(reference.few_letters(iter([pa.record_batch({"letters": texts})]), "letters"))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 10 for p in parts)
    rows = [p.num_rows for p in mapping.few_reads(iter([pa.record_batch({"i": list(range(2500))})]))]
    assert rows == [1024, 1024, 452]


@given(st.lists(st.none() | st.text("ACGTacgtNé😀", max_size=12), max_size=8), st.integers(1, 9))
@settings(deadline=None)
def test_ranks_of_many_sequences_at_once(texts, k):
    """As one by one: no k-mer reaches into the next sequence."""
    rank = lambda s: sum(max(0, "ACGT".find(c.upper())) * 4 ** (k - 1 - j) for j, c in enumerate(s))
    want = [[rank(s[i : i + k]) for i in range(len(s) - k + 1)] for s in (t or "" for t in texts)]
    offsets, ranks = bases.rank_lists(pa.array(texts, pa.string()), k)
    assert [ranks[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want and offsets[-1] == len(ranks)
