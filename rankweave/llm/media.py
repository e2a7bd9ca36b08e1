"""Audio features of media columns.

Samples are stored losslessly as 8-bit mono PCM in a WAV container. Reading them back gives a signal
that a polyphase filter resamples (each output phase has its own short filter, so nothing is
filtered at the higher rate), overlapping windowed frames turn into log energies of overlapping mel
bands, and a hysteresis on frame energy (a span opens above the upper and closes below the lower
threshold) cuts time spans. Spans are laid into tensors of one fixed shape (frames x bands, padded with
the floor value), stored as an Arrow fixed-shape tensor column beside their times.

Null and empty payloads store as one block of zero bytes; silence has no span and so no tensor. Long
payloads go through in blocks of frames, so memory doesn't grow with the square of anything. Equal
payloads give equal values: each is computed by itself. Repeated rows each come back; an empty table
gives an empty result; only doc_id and text are read.
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

PAD = 64
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class AudioSpec:
    """Rates in Hz, lengths in samples of the resampled signal."""

    rate: int = 16_000
    up: int = 441  # to 11,025 Hz
    down: int = 640
    taps: int = 12  # each side and phase
    frame: int = 276
    hop: int = 110
    fft: int = 512
    bands: int = 40
    tensor_frames: int = 32
    floor: float = -10.0
    open_at: float = 0.5  # deviations above the mean frame energy
    close_at: float = -0.25

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def store_wav(payload: bytes, rate: int = AudioSpec.rate) -> bytes:
    """8-bit unsigned mono PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples of a stored file."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


@lru_cache(maxsize=8)
def phase_filters(up: int, down: int, taps: int) -> np.ndarray:
    """One short filter for each of the `up` output phases (rows): a windowed sinc at the lower of both
    rates' limits, taken at every up-th place from the phase on."""
    wide = max(up, down)
    half = taps * wide
    at = np.arange(-half, half + 1)
    low_pass = np.sinc(at / wide) * np.hanning(len(at) + 2)[1:-1] * up / wide
    length = -(-len(at) // up)
    return np.pad(low_pass, (0, length * up - len(at))).reshape(length, up).T.astype(np.float32)


def resample(signal: np.ndarray, spec: AudioSpec, block: int = 1 << 15) -> np.ndarray:
    """Polyphase resampling by up / down: output n weighs input samples by the filter of phase
    (n * down) mod up only. Done in blocks of outputs, so memory stays bounded."""
    filters = phase_filters(spec.up, spec.down, spec.taps)
    length = filters.shape[1]
    half = spec.taps * max(spec.up, spec.down)
    padded = np.concatenate([np.zeros(length, np.float32), signal, np.zeros(length + half // spec.up + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)[:, ::-1]  # row i: samples i - 1, i - 2, ...
    out = np.empty(-(-len(signal) * spec.up // spec.down), dtype=np.float32)
    for first in range(0, len(out), block):
        base, phase = np.divmod(np.arange(first, min(first + block, len(out)), dtype=np.int64) * spec.down + half, spec.up)
        out[first : first + block] = np.einsum("ij,ij->i", windows[base + 1], filters[phase])
    return out


@lru_cache(maxsize=8)
def mel_bands(spec: AudioSpec) -> np.ndarray:
    """Triangles that overlap by half, evenly spread on the mel scale: (fft // 2 + 1) x bands."""
    top = 2595 * np.log10(1 + spec.out_rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, spec.bands + 2) / 2595) - 1)
    hertz = np.arange(spec.fft // 2 + 1) * spec.out_rate / spec.fft
    rise = (hertz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - hertz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(signal: np.ndarray, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """Log mel energies (frames x bands) and log energy of each frame; the last frame is zero-padded."""
    count = max(1, -(-max(0, len(signal) - spec.frame) // spec.hop) + 1)
    padded = np.zeros((count - 1) * spec.hop + spec.frame, dtype=np.float32)
    padded[: len(signal)] = signal[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, spec.frame)[:: spec.hop]
    window = np.hanning(spec.frame).astype(np.float32)
    bands, energy = np.empty((count, spec.bands), np.float32), np.empty(count, np.float32)
    for first in range(0, count, 2048):
        block = frames[first : first + 2048] * window
        power = np.abs(np.fft.rfft(block, spec.fft)).astype(np.float32) ** 2
        bands[first : first + 2048] = np.log(power @ mel_bands(spec) + np.float32(np.exp(spec.floor)))
        energy[first : first + 2048] = np.log((block**2).sum(axis=1) + np.float32(np.exp(spec.floor)))
    return bands, energy


def segments(energy: np.ndarray, spec: AudioSpec) -> list[tuple[int, int]]:
    """Frame spans by hysteresis; a span that is still open at the end closes there."""
    spread = float(energy.std())
    if spread < 1e-6:
        return []
    mean = float(energy.mean())
    high, low = energy > mean + spec.open_at * spread, energy < mean + spec.close_at * spread
    # The last frame that was either high or low decides whether a span is open.
    said = np.where(high, 1, np.where(low, -1, 0))
    last = np.maximum.accumulate(np.where(said != 0, np.arange(len(said)), -1))
    open_ = np.concatenate([[False], (last >= 0) & (said[np.maximum(last, 0)] == 1), [False]])
    edges = np.diff(open_.astype(np.int8))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def tensors(media: bytes, spec: AudioSpec) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Fixed-shape tensors (n x tensor_frames x bands) of a stored file and their times in seconds."""
    signal = (np.frombuffer(read_wav(media), np.uint8).astype(np.float32) - 128) / 128
    signal -= signal.mean(dtype=np.float64).astype(np.float32)
    bands, energy = log_mel(resample(signal, spec), spec)
    step = spec.hop / spec.out_rate
    parts, times = [], []
    for start, end in segments(energy, spec):
        for first in range(start, end, spec.tensor_frames):
            last = min(end, first + spec.tensor_frames)
            tensor = np.full((spec.tensor_frames, spec.bands), spec.floor, np.float32)
            tensor[: last - first] = bands[first:last]
            parts.append(tensor)
            times.append((first * step, (last - 1) * step + spec.frame / spec.out_rate))
    return np.stack(parts) if parts else np.empty((0, spec.tensor_frames, spec.bands), np.float32), times


def tensor_table(media: bytes, spec: AudioSpec) -> pa.Table:
    """start_s, end_s and log_mel, an Arrow fixed-shape tensor column."""
    values, times = tensors(media, spec)
    kind = pa.fixed_shape_tensor(pa.float32(), (spec.tensor_frames, spec.bands))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), spec.tensor_frames * spec.bands)
    return pa.table({"start_s": pa.array([a for a, _ in times], pa.float64()), "end_s": pa.array([b for _, b in times], pa.float64()), "log_mel": pa.ExtensionArray.from_storage(kind, flat)})


def tensor_stream(media: bytes, spec: AudioSpec) -> bytes:
    """tensor_table as an Arrow IPC stream."""
    sink = io.BytesIO()
    found = tensor_table(media, spec)
    with pa.ipc.new_stream(sink, found.schema) as writer:
        writer.write_table(found)
    return sink.getvalue()


def _stored(text: str | None, spec: AudioSpec) -> tuple[int, bytes]:
    """Bytes of a text, and these, padded, as a stored file."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), store_wav(raw + bytes((-len(raw)) % PAD or (PAD if not raw else 0)), spec.rate)


def store_media(docs: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, padded, as a stored file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_stored(text.as_py(), spec) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_features(docs: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """extract(store_media(docs)) in one pass of Python workers, in batches of few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_bytes", "media", "tensors"], (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, media = _stored(text.as_py(), spec)
                rows.append((doc_id.as_py(), n, media, tensor_stream(media, spec)))
                size += len(media) + len(rows[-1][3])
                if size > PIECE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, tensors binary")


def extract(stored: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """The stored rows with tensors: an Arrow IPC stream with start_s, end_s and the fixed-shape tensor log_mel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):  # streams of many rows would outgrow a batch
                streams = pa.array([tensor_stream(media.as_py(), spec) for media in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, streams], names=[*part.schema.names, "tensors"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, tensors binary")


def _pieces(batch: pa.RecordBatch, rows: int = 64, most_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and, but for single rows, so many bytes of media."""
    first, size = 0, 0
    for at, media in enumerate(batch.column(2)):
        n = len(media.as_buffer())
        if at > first and (at - first >= rows or size + n > most_bytes):
            yield batch.slice(first, at - first)
            first, size = at, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def read_tensors(stream: bytes) -> pa.Table:
    """The table of one row of extract()."""
    return pa.ipc.open_stream(stream).read_all()


def summary(found: pa.Table, spec: AudioSpec = AudioSpec()) -> str:
    """Shape, number, covered seconds and mean of the tensors of read_tensors, to three places."""
    values = found["log_mel"].combine_chunks()
    flat = values.storage.flatten().to_numpy() if len(values) else np.empty(0, np.float32)
    covered = float(np.sum(found["end_s"].to_numpy() - found["start_s"].to_numpy()))
    mean = float(flat.mean(dtype=np.float64)) if len(flat) else 0.0
    return f"shape={spec.tensor_frames}x{spec.bands};tensors={len(values)};seconds={covered:.3f};mean={mean:.3f}"


def digests(extracted: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """What the stored files and tensors of extract() hold once read back: digests of the payload and of the
    media, and a summary of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n_bytes, media, stream in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                media = media.as_py()
                payload = read_wav(media)
                feature = summary(read_tensors(stream.as_py()), spec)
                out.append((n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return extracted.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
