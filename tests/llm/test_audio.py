import hashlib
import io
import wave
import zlib

import numpy as np

from lumenqa.llm import audio
from lumenqa.llm.entry import op2_audio_features
from lumenqa.llm.workspace import Workspace


def test_wav_is_read_by_the_standard_library():
    payload = bytes(range(256)) * 3
    with wave.open(io.BytesIO(audio.wav(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.RATE)
        assert w.readframes(w.getnframes()) == payload
    assert audio.samples_of(audio.wav(payload)) == payload


def test_polyphase_equals_the_zero_stuffed_filter():
    x = np.random.default_rng(1).normal(size=1001)
    bank = audio.phases()[:, ::-1]  # phase, tap
    h = bank.T.ravel()
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    full = np.convolve(stuffed, h)
    delay = (audio.TAPS // 2) * audio.UP
    want = np.concatenate([full, np.zeros(200)])[delay : delay + len(stuffed)][:: audio.DOWN]
    assert np.allclose(audio.resampled(x), want[: len(audio.resampled(x))])
    t = np.arange(16000) / audio.RATE
    y = audio.resampled(np.sin(2 * np.pi * 440 * t))
    assert np.argmax(np.abs(np.fft.rfft(y[:12000]))) == 440


def test_segments_by_hysteresis():
    energy = np.array([0, 0, 5, 3, 3, 5, 0, 0, 3, 0], float)
    low, high = 1, 4

    def plain(e, low, high):
        on, out = False, []
        for v in e:
            on = v >= high or (on and v >= low)
            out.append(on)
        return out

    assert plain(energy, low, high) == [False, False, True, True, True, True, False, False, False, False]
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        e = rng.normal(size=n).round(3)
        hi, lo = np.quantile(e, [audio.UPPER, audio.LOWER])
        on = np.array(plain(e, lo, hi))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
        assert len(audio.segments(e)) == len(edges) // 2


def test_log_mel_and_energies_equal_sums_over_samples():
    """Frames, discrete Fourier sums, triangles and logarithms written out."""
    rng = np.random.default_rng(5)
    for n in (1, 299, 300, 301, 660, 1000):
        y = rng.normal(size=n)
        mel, energy = audio.log_mel(y)
        frames = 1 + max(0, -(-(n - audio.FRAME) // audio.HOP))
        assert mel.shape == (frames, audio.MELS) and len(energy) == frames
        to_mel, back = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
        edges = [back(to_mel(audio.RATE_OUT / 2) * i / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
        for f in range(frames):
            x = np.array([y[f * audio.HOP + i] if f * audio.HOP + i < n else 0.0 for i in range(audio.FRAME)])
            assert abs(energy[f] - np.log(sum(v * v for v in x) / audio.FRAME + 1e-9)) < 1e-3
            w = x * [0.5 - 0.5 * np.cos(2 * np.pi * i / (audio.FRAME - 1)) for i in range(audio.FRAME)]
            at = np.arange(audio.FRAME)
            power = [abs((w * np.exp(-2j * np.pi * k * at / audio.FFT)).sum()) ** 2 for k in range(audio.FFT // 2 + 1)]
            for m in range(audio.MELS):
                a, b, c = edges[m : m + 3]
                total = 0.0
                for k, e in enumerate(power):
                    hz = k * audio.RATE_OUT / audio.FFT
                    total += e * max(0.0, min((hz - a) / (b - a), (c - hz) / (c - b)))
                assert abs(mel[f, m] - np.log(total + 1e-6)) < 2e-3


def test_query_round_trip(spark):
    rows = op2_audio_features(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(audio.wav(payload)).hexdigest()
        assert by_text.setdefault(raw, r.feature) == r.feature


def test_edges(spark):
    rows = [(1, None, "m"), (1, "", "m"), (None, "ab", "m"), (2, "é" * 32, "m"), (3, "x" * 2_000_000, "m"), (4, "ab", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    work = Workspace(spark)
    out = audio.features(work.table(audio.stored(docs), "media")).collect()
    assert sorted(r.payload_bytes for r in out) == [64, 64, 64, 64, 64, 2_000_000]
    same = [r.tensors for r in out if r.n_bytes == 2]
    assert len(same) == 2 and same[0] == same[1]
    for r in out:
        t = audio.tensors_of(r.tensors)
        assert t.column("logmel").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
        assert sum(t.column("frames").to_pylist()) == r.frames
        assert t.column("end").to_pylist()[-1] >= r.payload_bytes / audio.RATE - 0.01
    assert audio.features(audio.stored(docs.limit(0))).collect() == []
    work.drop()
