"""Arrow-batched pixel kernels, for images that come as arrays; `pixels` has relational twins of most."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FEATURES = ["optical_flow_mag", "lbp_entropy", "bright_pixel_ratio", "contour_convexity", "pixel_diff_mean", "thermal_gradient", "bright_zone_area", "texture_roughness", "edge_density", "temporal_change_score"]


#: Images of one shape are taken together, up to so many pixels, or one by one if they are larger.
TOGETHER = 1 << 18


def lbp_entropies(imgs: np.ndarray, points: int = 24, radius: float = 3.0) -> np.ndarray:
    """Entropy of uniform local binary patterns of each image of a stack, over a density histogram of points + 2 bins."""
    n, h, w = imgs.shape
    angle = 2 * np.pi * np.arange(points) / points
    dy, dx = np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5)
    off = int(radius) + 2
    padded = np.pad(imgs.astype(float), ((0, 0), (off, off), (off, off)))  # outside counts as 0
    bits = np.empty((points, n, h, w), dtype=bool)
    for i in range(points):
        y, x = np.arange(h)[:, None] + dy[i] + off, np.arange(w)[None, :] + dx[i] + off
        a, b, fy, fx = int(y[0, 0]), int(x[0, 0]), y - np.floor(y), x - np.floor(x)
        at = [[padded[:, a + j : a + j + h, b + k : b + k + w] for k in (0, 1)] for j in (0, 1)]
        near = at[0][0] * (1 - fy) * (1 - fx) + at[0][1] * (1 - fy) * fx + at[1][0] * fy * (1 - fx) + at[1][1] * fy * fx
        bits[i] = near - imgs >= -1e-12
    turns = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    codes = np.where(turns <= 2, bits.sum(axis=0), points + 1).reshape(n, -1)
    counts = np.bincount((codes + np.arange(n)[:, None] * (points + 2)).ravel(), minlength=n * (points + 2)).reshape(n, -1)
    spread = np.ptp(codes, axis=1)[:, None]  # a code has a bin to itself, as bins are narrower than 1
    density = counts * (points + 2) / (h * w * np.where(spread, spread, 1))
    return -(density * np.log2(np.where(counts, density, 1))).sum(axis=1)


def lbp_entropy(img: np.ndarray, points: int = 24, radius: float = 3.0) -> float:
    """Entropy of uniform local binary patterns of one image."""
    return float(lbp_entropies(img[None], points, radius)[0])


def ssim_distance(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    spread = max(np.ptp(a), np.ptp(b))
    spread = 1.0 if spread < 1e-8 else spread
    n = window * window
    # window sums are differences of summed areas; frames are centred first, so that these stay small and exact
    far_a, far_b = a.mean(), b.mean()
    a, b = a - far_a, b - far_b
    areas = np.zeros((5, a.shape[0] + 1, a.shape[1] + 1))
    np.stack([a, b, a * a, b * b, a * b]).cumsum(axis=1).cumsum(axis=2, out=areas[:, 1:, 1:])
    ma, mb, aa, bb, ab = (areas[:, window:, window:] - areas[:, :-window, window:] - areas[:, window:, :-window] + areas[:, :-window, :-window]) / n
    k = n / (n - 1)
    va, vb, cov = k * (aa - ma * ma), k * (bb - mb * mb), k * (ab - ma * mb)
    ma, mb = ma + far_a, mb + far_b
    c1, c2 = (0.01 * spread) ** 2, (0.03 * spread) ** 2
    return float(1 - ((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def sobel(img: np.ndarray) -> np.ndarray:
    s = np.lib.stride_tricks.sliding_window_view(img, (3, 3), axis=(-2, -1))
    gx = s[..., 0, 2] + 2 * s[..., 1, 2] + s[..., 2, 2] - s[..., 0, 0] - 2 * s[..., 1, 0] - s[..., 2, 0]
    gy = s[..., 2, 0] + 2 * s[..., 2, 1] + s[..., 2, 2] - s[..., 0, 0] - 2 * s[..., 0, 1] - s[..., 0, 2]
    return np.hypot(gx, gy)


#: What the differences of a frame in [0, 1] are multiplied by. The published features divide them by bounds that hold for gray
#: levels, so that an edge is never found; `unit` takes them on gray levels.
SCALES = {"reference": 1.0, "unit": 255.0}


def vectors(imgs: np.ndarray, before: np.ndarray | None, scale: str = "reference") -> dict[str, np.ndarray]:
    """The ten features of each frame of a stack (frames x rows x columns) in [0, 1]; those of a pair are 0 without earlier frames."""
    gain, each = SCALES[scale], (1, 2)
    gray = np.floor(imgs * 255)
    lap = imgs[:, 1:-1, 2:] + imgs[:, 1:-1, :-2] + imgs[:, 2:, 1:-1] + imgs[:, :-2, 1:-1] - 4 * imgs[:, 1:-1, 1:-1]
    m = np.hypot(imgs[:, 1:-1, 2:] - imgs[:, 1:-1, :-2], imgs[:, 2:, 1:-1] - imgs[:, :-2, 1:-1]) * gain / 510
    strong = np.pad(m > 0.3, ((0, 0), (1, 1), (1, 1)))
    near = strong[:, 1:-1, 1:-1] | strong[:, :-2, 1:-1] | strong[:, 2:, 1:-1] | strong[:, 1:-1, :-2] | strong[:, 1:-1, 2:]
    none = np.zeros(len(imgs))
    diff = np.abs(imgs - before).mean(axis=each) if before is not None else none
    return {
        "optical_flow_mag": none, "lbp_entropy": lbp_entropies(gray), "bright_pixel_ratio": (gray > 200).mean(axis=each), "contour_convexity": none + 1, "pixel_diff_mean": diff,
        "thermal_gradient": sobel(imgs).mean(axis=each) * gain / 1448, "bright_zone_area": (gray > 180).mean(axis=each), "texture_roughness": lap.std(axis=each) * gain / 255, "edge_density": ((m > 0.1) & near).mean(axis=each),
        "temporal_change_score": diff / (1 + before.std(axis=each) + 1e-6) if before is not None else none,
    }


def vector(img: np.ndarray, before: np.ndarray | None, scale: str = "reference") -> dict[str, float]:
    """The ten features of one frame in [0, 1]; those of a pair are 0 without an earlier frame."""
    return {k: float(v[0]) for k, v in vectors(img[None], None if before is None else before[None], scale).items()}


PAIR = ["night_score", "mad", "most", "p95", "temporal_change", "ssim_distance"]


def pair(img: np.ndarray, before: np.ndarray | None, dim: float, dark: float = 30 / 255, bright: float = 60 / 255, similarity: bool = True) -> tuple:
    """Night score of a frame (its values times `dim`), and what sets it apart from an earlier one of the
    same shape; null without one. SSIM, the dearest, is null too without `similarity`."""
    low = img * dim
    night = 0.0 if low.mean() >= dark else float((low > bright).mean())
    if before is None or before.shape != img.shape:
        return (night, *[None] * 5)
    d = np.abs(img - before)
    return night, float(d.mean()), float(d.max()), float(np.percentile(d, 95)), float(d.mean() / (1 + before.std() + 1e-6)), ssim_distance(img, before) if similarity else None


def pair_scores(frames: DataFrame, keep: list[str], dim: float = 1.0, similarity: bool = True) -> DataFrame:
    """keep columns and the scores of PAIR, from frames(width, pixels, before): the pixels of a frame
    and of the one it is compared with (null without) as arrays by rows."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            of = lambda x, w: None if x is None else np.asarray(x, float).reshape(-1, int(w))
            rows = [pair(of(a, w), of(b, w), dim, similarity=similarity) for w, a, b in zip(pdf["width"], pdf["pixels"], pdf["before"], strict=True)]
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(rows, columns=PAIR, dtype="Float64")], axis=1)

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in keep)
    return frames.select(*keep, "width", "pixels", "before").mapInPandas(run, kinds + ", " + ", ".join(f"{c} double" for c in PAIR))


STATS = ["mean", "std", "variance", "low", "high", "entropy", "above_200", "above_180", "night_score", "p90", "gray_mean", "gray_variance"]


def single(img: np.ndarray, dim: float) -> tuple:
    """STATS of the values of one frame in [0, 1]; the night score is that of values times dim."""
    gray = np.floor(img * 255)
    _, n = np.unique(gray, return_counts=True)
    share = n / img.size
    return (
        img.mean(), img.std(), img.var(), img.min(), img.max(), abs((share * np.log2(share)).sum()), (gray > 200).mean(), (gray > 180).mean(),
        pair(img, None, dim)[0], np.percentile(img, 90), gray.mean(), gray.var(),
    )


def frame_stats(frames: DataFrame, keep: list[str], dim: float = 1.0) -> DataFrame:
    """keep columns and STATS, from frames(pixels): an array by rows. Null arrays, arrays without values and arrays with a missing value give nulls.

    An image is one row and is never shuffled; `pixels` has relational twins."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            of = lambda x: None if x is None or not len(x) else np.asarray(x, float)
            images = map(of, pdf["pixels"])
            rows = [(None,) * len(STATS) if x is None or np.isnan(x).any() else single(x, dim) for x in images]
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(rows, columns=STATS, dtype="Float64")], axis=1)

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in keep)
    return frames.select(*keep, "pixels").mapInPandas(run, kinds + ", " + ", ".join(f"{c} double" for c in STATS))


def png_of(img: np.ndarray) -> bytes:
    """A PNG file of gray levels (rows x columns) or colours (rows x columns x 3)."""
    img = np.asarray(img, dtype=np.uint8)
    raw = b"".join(b"\x00" + row.tobytes() for row in img)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0 if img.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def gray_of_png(data: bytes) -> np.ndarray:
    """Gray levels (rows x columns) of a PNG with 8-bit gray or colour samples; an error says why not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    try:
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += n + 12
        channels = {0: 1, 2: 3, 6: 4}.get(head[3]) if head and head[2] == 8 and not head[6] else None
        if channels is None:
            raise ValueError("not 8-bit gray or colour")
        rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(head[1], 1 + head[0] * channels)
        img = unfiltered(rows, channels).reshape(head[1], head[0], channels).astype(float)
    except (struct.error, zlib.error, IndexError) as x:  # a damaged file, whatever is wrong with it
        raise ValueError(f"damaged: {x}") from x
    return img[:, :, 0] if channels == 1 else img[:, :, :3] @ [0.299, 0.587, 0.114]


def unfiltered(rows: np.ndarray, channels: int) -> np.ndarray:
    """The samples of filtered rows, whose first byte names the filter: each predicts a sample from those to the left and above."""
    out, above = np.zeros((len(rows), rows.shape[1] - 1), dtype=np.int64), np.zeros(rows.shape[1] - 1, dtype=np.int64)
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:].astype(np.int64), strict=True)):
        if kind > 4:
            raise IndexError("no such filter")
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = line.reshape(-1, channels).cumsum(axis=0).ravel() & 255
        elif kind == 2:
            out[y] = (line + above) & 255
        else:
            for x in range(0, len(line), channels):
                left, corner = (out[y, x - channels : x], above[x - channels : x]) if x else (0, 0)
                up = above[x : x + channels]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y, x : x + channels] = (line[x : x + channels] + guess) & 255
        above = out[y]
    return out


def features(frames: DataFrame, scale: str = "reference") -> DataFrame:
    """image_id and its ten features, from frames(image_id, width, pixels, before): the
    pixels of a frame and of the earlier one (null without) as arrays by rows; scale: one of SCALES.

    Frames of a batch that have one shape are computed together."""
    order = [list(vectors(np.zeros((1, 3, 3)), None)).index(f) for f in FEATURES]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            long = lambda x: -1 if x is None else len(x)
            alike = pd.Series(range(len(pdf))).groupby([pdf["width"].to_numpy(), pdf["pixels"].map(long).to_numpy(), pdf["before"].map(long).to_numpy()])
            out = np.zeros((len(pdf), len(FEATURES)))
            for (w, size, earlier), at in alike:
                for i in range(0, len(at), step := max(1, TOGETHER // max(1, size))):
                    part = at.to_numpy()[i : i + step]
                    stack = lambda c: np.array([np.asarray(x, float) for x in pdf[c].iloc[part]]).reshape(len(part), -1, int(w))  # noqa: E731, B023
                    out[part] = np.column_stack([*vectors(stack("pixels"), None if earlier < 0 else stack("before"), scale).values()])[:, order]
            yield pd.concat([pdf[["image_id"]].reset_index(drop=True), pd.DataFrame(out, columns=FEATURES)], axis=1)

    return frames.select("image_id", "width", "pixels", "before").mapInPandas(run, "image_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def preprocess(images: DataFrame, size: int = 256, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, pixels (size x size gray levels), mean, std, variance, error from images(path, width,
    pixels 0..255): crop to box (x_min, x_max, y_min, y_max), area-weighted resize, stretch to
    the whole range. A row that fails carries its error; others go on."""

    def shrink(a: np.ndarray, n: int) -> np.ndarray:
        edge = np.linspace(0, a.shape[0], n + 1)
        total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        low = np.minimum(np.floor(edge).astype(int), a.shape[0])
        at = total[low] + (edge - low)[:, None] * np.vstack([a, np.zeros((1, a.shape[1]))])[low]
        return np.diff(at, axis=0) / np.diff(edge)[:, None]

    def one(path: str, w: float, px: np.ndarray | None) -> dict:
        try:
            a = np.asarray(px, float).reshape(-1, int(w))
            a = a if box is None else a[box[2] : box[3], box[0] : box[1]]
            a = shrink(shrink(a, size).T, size).T / 255
            spread = np.ptp(a)
            a = np.zeros_like(a) if spread < 1e-6 else (a - a.min()) / spread
            g = np.floor(a * 255)
            return {"path": path, "pixels": g.ravel(), "mean": g.mean(), "std": g.std(), "variance": g.var(), "error": None}
        except (TypeError, ValueError) as x:
            return {"path": path, "pixels": None, "mean": None, "std": None, "variance": None, "error": str(x)}

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pd.DataFrame([one(*x) for x in zip(pdf["path"], pdf["width"], pdf["pixels"], strict=True)])

    return images.select("path", "width", "pixels").mapInPandas(run, "path string, pixels array<double>, mean double, std double, variance double, error string")
