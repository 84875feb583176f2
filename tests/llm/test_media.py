import cmath
import hashlib
import math
import zlib

import numpy as np

from tidewatch.llm import media


def test_round_trip(spark):
    texts = [None, "", "a", "a" * 64, "é" * 40, "The quick brown fox. " * 5000, "a"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.media_columns(df)
    got = {r.doc_id: r for r in media.media_digests(stored).collect()}
    assert got.keys() == set(range(len(texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = media.pad(data)
        assert got[i].n_bytes == len(data) and got[i].payload_bytes == len(payload) and len(payload) % 64 == 0
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert got[i].media_bytes == len(payload) + 44
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[6][1:] and got[2].feature != got[5].feature
    assert {r.doc_id: len(r.codes) == len(r.times) for r in stored.collect()} == {i: True for i in range(len(texts))}
    assert media.media_digests(media.media_columns(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_every_byte_enters_a_transform():
    rng = np.random.default_rng(3)
    for size in (64, 128, 256, 320, 448, 512, 1024):
        samples = rng.integers(32, 127, size).astype(np.uint8)
        plain = np.concatenate(list(media.spectra(samples)))
        for at in range(size):
            other = samples.copy()
            other[at] ^= 64
            assert np.abs(np.concatenate(list(media.spectra(other))) - plain).max() > 10


def test_text_ends_and_frame_borders_reach_the_feature(spark):
    texts = []
    for size in (300, 320, 448, 700):
        text = "".join(map(chr, np.random.default_rng(size).integers(97, 123, size)))
        texts += [text, text[:-64] + "aazz" * 16, text[:240] + "aazz" * 8 + text[272:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.feature for r in media.media_digests(media.media_columns(df)).collect()}
    for i in range(0, len(texts), 3):
        assert got[i] != got[i + 1] and got[i] != got[i + 2]


def test_blocks_of_frames_join(monkeypatch):
    samples = np.random.default_rng(5).integers(0, 256, 128 * 40 + 64).astype(np.uint8)
    whole = media.spectral_peaks(samples)
    assert len(whole) == 42
    for block in (1, 2, 7, 42):
        monkeypatch.setattr(media, "BLOCK", block)
        assert (media.spectral_peaks(samples) == whole).all()


def test_fingerprints_are_those_of_a_plain_transform(spark):
    def plain(data):
        """Peaks by sums of sines and cosines, and their pairs in order of time."""
        n = len(data)
        at = lambda i: data[(i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)] - 128
        hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / 255) for k in range(256)]
        peaks = []
        for f in range(-(-n // 128) + 1):
            frame = [at((f - 1) * 128 + k) * hann[k] for k in range(256)]
            power = [abs(sum(x * cmath.exp(-2j * math.pi * b * k / 256) for k, x in enumerate(frame))) for b in range(2, 129)]
            peaks.append(2 + max(range(len(power)), key=power.__getitem__))
        return sorted((i, (peaks[i] << 16) | (peaks[i + gap] << 4) | gap) for i in range(len(peaks)) for gap in (1, 2, 3) if i + gap < len(peaks))

    texts = ["".join(map(chr, np.random.default_rng(size).integers(97, 123, size))) for size in (1, 63, 256, 300, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_columns(df).collect():
        assert list(zip(r.times, r.codes, strict=True)) == plain(texts[r.doc_id].encode()), len(texts[r.doc_id])
