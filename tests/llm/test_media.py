import hashlib
import zlib

import numpy as np

from cellweave.llm import media
from cellweave.llm.media import BANDS, FRAME, HOP, PATCH, TENSORS, Clip, analysed, audio_features, audio_tensors, clips_of, log_mel, media_digests, payload_of, read_back, read_tensors, resample, segments, store, stored_media, write_tensors

from .helpers import frame

TEXTS = [None, "", "a", "é" * 40, "x" * 64, "y" * 65, "word " * 20_000, "\x00\x00", "same", "same"]


def test_round_trip(spark):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in media_digests(frame(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        n = max(64, -(-len(raw) // 64) * 64)
        payload = raw.ljust(n, b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        wav = store(payload)
        assert read_back(wav) == (payload, 8000) and (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert got[8][2:] == got[9][2:] and got[8].feature == got[9].feature and got[0].feature == got[1].feature
    assert media_digests(frame(spark, [])).count() == 0


def test_features_do_not_depend_on_the_batch(spark):
    rows = list(enumerate(TEXTS * 3))
    one = {r.doc_id: r.feature for r in media_digests(frame(spark, rows).coalesce(1)).collect()}
    assert one == {r.doc_id: r.feature for r in media_digests(frame(spark, rows).repartition(7)).collect()}


def test_patches(spark):
    got = audio_features(stored_media(frame(spark, list(enumerate(TEXTS))))).orderBy("doc_id", "patch").collect()
    assert {len(r.tensor) for r in got} == {PATCH * BANDS}
    clip = analysed(payload_of(TEXTS[6]), 8000)
    mine = [r for r in got if r.doc_id == 6]
    mel = np.array([r.tensor for r in mine], np.float32).reshape(-1, BANDS)
    assert (mel[: len(clip.mel)] == clip.mel).all() and not mel[len(clip.mel) :].any() and len(mine) == -(-len(clip.mel) // PATCH)
    assert all(a.stop_s > b.start_s >= a.start_s for a, b in zip(mine, mine[1:]))
    assert abs(mine[-1].stop_s - ((len(clip.mel) - 1) * HOP + FRAME) / 4000) < 1e-9


def test_tensors_come_back(spark):
    clips = [analysed(payload_of(t), 8000) for t in TEXTS]
    table = read_tensors(write_tensors(clips))
    assert table.schema == TENSORS and table.column("mel").type.shape == [PATCH, BANDS]
    back = clips_of(table)
    assert len(back) == len(clips) and all((a.mel == b.mel).all() and (a.power == b.power).all() and a.text() == b.text() for a, b in zip(back, clips))
    assert clips_of(read_tensors(write_tensors([]))) == []
    files = spark.createDataFrame([(1, bytearray(store(b"x" * 64))), (2, None), (3, bytearray(b"RIFF")), (4, bytearray(b""))], "doc_id long, media binary")
    got = {r.doc_id: r for r in audio_tensors(files).collect()}
    assert {i: r.n_patches for i, r in got.items()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert clips_of(read_tensors(bytes(got[1].tensors)))[0].text() == analysed(b"x" * 64, 8000).text()
    assert {r.doc_id for r in audio_features(files).collect()} == {1}


def brute_clip(payload):
    """By direct convolution, a direct Fourier sum and a loop over bands."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    half = media.TAPS * media.DOWN
    t = np.arange(-half, half + 1) / media.DOWN
    h = np.sinc(t) * np.hanning(len(t) + 2)[1:-1] / media.DOWN
    y = [sum(x[j] * h[2 * k - j + half] for j in range(max(0, 2 * k - half), min(len(x), 2 * k + half + 1))) for k in range(-(-len(x) // 2))]
    n = 1
    while (n - 1) * HOP + FRAME < len(y):
        n += 1
    y = np.array(y + [0.0] * ((n - 1) * HOP + FRAME - len(y)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))
    waves = np.exp(-2j * np.pi * np.outer(np.arange(FRAME // 2 + 1), np.arange(FRAME)) / FRAME)
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    corner = [to_hz(to_mel(2000) * k / (BANDS + 1)) for k in range(BANDS + 2)]
    mel, power = [], []
    for k in range(n):
        part = y[k * HOP : k * HOP + FRAME]
        energy, row = np.abs(waves @ (part * window)) ** 2, []
        for low, mid, high in zip(corner, corner[1:], corner[2:]):
            total = 0.0
            for b, e in enumerate(energy):
                f = b * 4000 / FRAME
                total += e * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))
            row.append(np.log10(max(total, 1e-10)))
        mel.append(row)
        power.append(10 * np.log10(max((part**2).mean(), 1e-10)))
    on, active, high, low = False, [], np.mean(power) + np.std(power) / 2, np.mean(power) - np.std(power) / 2
    for p in power:
        on = p > high or (on and p >= low)
        active.append(on)
    return np.array(mel), np.array(power), active


def test_features_as_by_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = ["a", "é" * 40, "The quick brown fox. " * 30, "quiet " + " " * 900 + "LOUD!! " * 150 + " " * 700 + "zzz", "".join(chr(c) for c in rng.integers(32, 0x250, 1500)), "\x00" * 700]
    got = {r.doc_id: r.feature for r in media_digests(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        mel, power, active = brute_clip(payload_of(t))
        clip = analysed(payload_of(t), 8000)
        assert np.allclose(clip.mel, mel, atol=2e-2) and np.abs(clip.mel - mel).mean() < 1e-3 and np.allclose(clip.power, power, atol=1e-2)
        f = dict(x.split("=") for x in got[i].split(";"))
        edges = np.flatnonzero(np.diff([0, *map(int, active), 0]))
        seconds = sum(((b - 1 - a) * HOP + FRAME) / 4000 for a, b in zip(edges[::2], edges[1::2]))
        assert int(f["frames"]) == len(mel) and int(f["segments"]) == len(edges) // 2 and abs(float(f["active_s"]) - seconds) < 1e-3
        assert np.allclose([float(x) for x in f["mel"].split("/")], [mel.mean(), mel.std()], atol=1e-2) and abs(float(f["db"]) - power.mean()) < 1e-2
        assert f["bands"] == hashlib.sha256(np.round(clip.mel.astype(float), 3).astype("<f4").tobytes()).hexdigest()[:16]


def test_the_last_bytes_count():
    base = "some words and more " * 40
    end = len(base.encode())
    assert len({analysed(payload_of(base[: end - k] + "#" * k), 8000).text() for k in (0, 1, 3, 9)}) == 4
    assert isinstance(analysed(payload_of(None), 8000), Clip)


def test_resampling_keeps_a_tone_and_drops_what_would_alias():
    t = np.arange(8000) / 8000
    low, high = np.sin(2 * np.pi * 500 * t), np.sin(2 * np.pi * 3000 * t)
    out = resample(low)
    assert len(out) == 4000 and np.abs(out[50:-50] - low[::2][50:-50]).max() < 0.02
    assert np.abs(resample(high)[50:-50]).max() < 0.02
    up = resample(low, 3, 2)
    assert len(up) == 12000 and np.abs(up[90:-90] - np.sin(2 * np.pi * 500 * np.arange(12000) / 12000)[90:-90]).max() < 0.02


def test_mel_finds_the_band_and_segments_have_hysteresis():
    t = np.arange(4000) / 4000
    lowest = [log_mel(np.sin(2 * np.pi * f * t), 4000)[0].mean(axis=0).argmax() for f in (200, 600, 1500)]
    assert lowest == sorted(set(lowest))
    power = np.array([-60.0] * 10 + [0, 0, -22, -22, 0, 0] + [-60] * 10)
    assert segments(power) == [(10, 16)]
    assert segments(np.zeros(5)) == []
