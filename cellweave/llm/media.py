"""Audio features of 8-bit sound, and texts stored as such sound.

A payload is kept as the samples of a mono 8-bit PCM WAVE file at 8 kHz, one byte a sample, so it comes back byte for byte.
Features are computed from the samples read back:

* *Resampling* to 4 kHz by a windowed-sinc low-pass filter in polyphase form (for a ratio up/down each output phase has its own
  short filter; no sample that is thrown away is computed).
* *Log-mel filterbanks*: frames of 256 samples, 128 apart, Hann window, power spectrum, 32 triangular mel bands, log10 with a floor.  The
  sound is followed by silence up to the end of the frame that holds its last sample.
* *Segments*: frames become active when their energy in dB exceeds the clip's mean by half a deviation, and stay so until it falls
  half a deviation below it, so that small dips do not split a segment.

The filterbanks are cut into patches of 32 frames, the last one zero-padded.  Patches and frame energies are stored as fixed-shape Arrow tensors
(32 x 32 and 32 float32) with their time spans, in an Arrow stream; digests and segments are taken from what is read back from it.  Spark has no
tensor type, so the streams are binary columns of its tables.  A clip is handled in stretches of bounded size, and alone, so its values do not depend on
what else is in a batch; what is held of it at once is its samples and, for every 128 of its resampled ones, a frame of 33 numbers.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.session import id_and_text
from cellweave.llm.words import slices

RATE, UP, DOWN = 8000, 1, 2
FRAME, HOP, BANDS, PATCH = 256, 128, 32, 32
TAPS = 8  # to each side, in input samples, times DOWN
UNIT = 64
STRETCH = 1 << 15  # samples handled at once, in cache
FLOOR = 1e-10


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono WAVE file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono is asked for")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache
def _phases(up: int, down: int) -> np.ndarray:
    """Filter of each output phase, over input samples."""
    half = TAPS * max(up, down)
    t = np.arange(-half, half + 1) / max(up, down)
    h = np.sinc(t) * np.hanning(len(t) + 2)[1:-1] * up / max(up, down)
    h = np.pad(h, (0, -len(h) % up))
    return h.reshape(-1, up).T


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """ceil(n * up / down) samples at up/down times the rate; silence is assumed outside."""
    phases = _phases(up, down)
    half, taps = TAPS * max(up, down), phases.shape[1]
    n = -(-len(x) * up // down)
    padded = np.pad(x.astype(np.float32), (taps, taps))
    out = np.zeros(n, np.float32)
    for first in range(min(up, n)):  # these outputs share a phase; their inputs are `down` apart
        at = first * down + half
        mine = out[first::up]
        for low in range(0, len(mine), STRETCH):
            part = mine[low : low + STRETCH]
            base = at // up + 1 + low * down
            for k, weight in enumerate(phases[at % up][::-1].tolist()):
                part += np.float32(weight) * padded[base + k : base + k + (len(part) - 1) * down + 1 : down]
    return out


@lru_cache
def mel_bank(rate: float, bands: int = BANDS, size: int = FRAME) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a power spectrum."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(size // 2 + 1) * rate / size
    rise, fall = (f - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - f) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands) log energies and each frame's power in dB; silence follows up to the end of the last frame."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, FRAME + (n - 1) * HOP - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate).T.astype(np.float32)
    mel, power = np.empty((len(frames), BANDS), np.float32), np.empty(len(frames), np.float32)
    for i in range(0, len(frames), 4 * STRETCH // FRAME):
        part = frames[i : i + 4 * STRETCH // FRAME]
        mel[i : i + len(part)] = np.log10(np.maximum(np.abs(np.fft.rfft(part * window)) ** 2 @ bank, FLOOR))
        power[i : i + len(part)] = 10 * np.log10(np.maximum((part * part).mean(axis=1), FLOOR))
    return mel, power


def segments(power: np.ndarray) -> list[tuple[int, int]]:
    """Active stretches of frames, by two thresholds around the mean."""
    power = power.astype(np.float64)
    high, low = power.mean() + power.std() / 2, power.mean() - power.std() / 2
    state = np.where(power > high, 1, np.where(power < low, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.r_[0, (known >= 0) & (state[known] == 1), 0].astype(int)
    edges = np.flatnonzero(np.diff(active))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@dataclass
class Clip:
    """Frames of a clip: mel (frames x bands) and power in dB, float32, and the rate they were taken at."""

    mel: np.ndarray
    power: np.ndarray
    rate: float

    def segments(self) -> list[tuple[float, float]]:
        """Start and end of each active segment, in seconds."""
        step = HOP / self.rate
        return [(a * step, (b - 1) * step + FRAME / self.rate) for a, b in segments(self.power)]

    def text(self) -> str:
        mel, power, active = self.mel.astype(np.float64), self.power.astype(np.float64), self.segments()
        digest = hashlib.sha256(np.round(mel, 3).astype("<f4").tobytes()).hexdigest()[:16]
        return f"frames={len(mel)};mel={mel.mean():.4f}/{mel.std():.4f};db={power.mean():.3f};segments={len(active)};active_s={sum(b - a for a, b in active):.4f};bands={digest}"


def analysed(samples: bytes, rate: int) -> Clip:
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    return Clip(*log_mel(x, rate * UP / DOWN), rate * UP / DOWN)


#: One row for each patch: the clip's place among those stored together, its rate, the patch's number, its span in seconds, its frames, and the tensors.
TENSORS = pa.schema(
    [("clip", pa.int32()), ("rate", pa.float64()), ("patch", pa.int32()), ("start_s", pa.float64()), ("stop_s", pa.float64()), ("frames", pa.int32())]
    + [("mel", pa.fixed_shape_tensor(pa.float32(), (PATCH, BANDS))), ("power", pa.fixed_shape_tensor(pa.float32(), (PATCH,)))]
)


def _tensor(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), kind.storage_type.list_size))


def write_tensors(clips: list[Clip]) -> bytes:
    """The clips' patches as an Arrow stream of fixed-shape tensors with time spans."""
    frames = np.array([len(c.mel) for c in clips], np.int64)
    patches = -(-frames // PATCH)
    first = np.cumsum(patches) - patches
    n, clip = int(patches.sum()), np.repeat(np.arange(len(clips)), patches)
    number = np.arange(n) - first[clip]
    mel, power = np.zeros((n * PATCH, BANDS), np.float32), np.zeros(n * PATCH, np.float32)
    for k, c in enumerate(clips):
        at = slice(first[k] * PATCH, first[k] * PATCH + frames[k])
        mel[at], power[at] = c.mel, c.power
    rate, held = np.array([c.rate for c in clips], np.float64)[clip], np.minimum(frames[clip] - number * PATCH, PATCH)
    start = number * PATCH * HOP / rate
    stop = start + ((held - 1) * HOP + FRAME) / rate
    cols = [pa.array(clip, pa.int32()), pa.array(rate), pa.array(number, pa.int32()), pa.array(start), pa.array(stop), pa.array(held, pa.int32()), _tensor(mel, TENSORS.field("mel").type), _tensor(power, TENSORS.field("power").type)]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, TENSORS) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays(cols, schema=TENSORS))
    return out.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """The table of TENSORS; its tensor columns give NumPy arrays by to_numpy_ndarray()."""
    with pa.ipc.open_stream(pa.py_buffer(stored)) as stream:
        return stream.read_all().combine_chunks()


def clips_of(table: pa.Table) -> list[Clip]:
    """The clips of a table of tensors, in their order."""
    clip, frames, rate = (table.column(c).to_numpy() for c in ("clip", "frames", "rate"))
    mel, power = (table.column(c).chunk(0).to_numpy_ndarray() if table.num_rows else None for c in ("mel", "power"))
    edges = np.r_[np.flatnonzero(np.diff(clip, prepend=-1)), len(clip)].tolist()
    out = []
    for i, j in zip(edges, edges[1:], strict=False):
        n = int(frames[i:j].sum())
        out.append(Clip(mel[i:j].reshape(-1, BANDS)[:n], power[i:j].ravel()[:n], float(rate[i])))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for part in slices(batch, size=1 << 20, rows=256):
            rows, clips = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                media = store(payload_of(text := text.as_py()))
                payload, rate = read_back(media)
                rows.append((doc, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
                clips.append(analysed(payload, rate))
            features = [c.text() for c in clips_of(read_tensors(write_tensors(clips)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True), features], kinds, strict=True)], names=names)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: sizes and hashes of what was stored and read back, and its features' text.  A null text is empty, 64 zero bytes."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_digests, DIGEST_SCHEMA)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each document's WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(payload_of(t)) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def _analysed(blob: bytes | None) -> Clip | None:
    try:
        return None if blob is None else analysed(*read_back(blob))
    except (wave.Error, EOFError, ValueError):
        return None


def audio_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, n_patches, tensors): a row for each clip, its patches as an Arrow stream (see TENSORS) that read_tensors() reads.

    A null value, or one that is no 8-bit mono WAVE file, has no patches and a null stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, blob in zip(batch.column(0), batch.column(1), strict=True):
                clip = _analysed(blob.as_py())
                n, stored = (0, None) if clip is None else (-(-len(clip.mel) // PATCH), write_tensors([clip]))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([stored], pa.binary())], names=["doc_id", "n_patches", "tensors"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, n_patches int, tensors binary")


def audio_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each patch: doc_id, patch, start_s, stop_s, tensor (32 x 32 floats, row by row), active (segments that meet it).

    Read from the stored tensors; a value without any (see audio_tensors()) has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, stored in zip(batch.column(0), batch.column(1), strict=True):
                t = read_tensors(stored.as_py())
                found = clips_of(t)[0].segments()
                starts, stops = (t.column(c).to_pylist() for c in ("start_s", "stop_s"))
                active = [[x for a, b in found if a < stop and b > start for x in (a, b)] for start, stop in zip(starts, stops, strict=True)]
                tensor = t.column("mel").chunk(0).storage.cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * t.num_rows, pa.int64()), *(t.column(c).chunk(0) for c in ("patch", "start_s", "stop_s")), tensor, pa.array(active, pa.list_(pa.float64()))],
                    names=["doc_id", "patch", "start_s", "stop_s", "tensor", "active"],
                )

    stored = audio_tensors(media, id_col, media_col).where("tensors is not null").select("doc_id", "tensors")
    return stored.mapInArrow(run, "doc_id long, patch int, start_s double, stop_s double, tensor array<float>, active array<double>")
