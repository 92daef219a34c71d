"""Image quality and noise over Spark's image source (rows of path, height, width, channels, BGR bytes)."""
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

BLUR_THRESHOLD, NOISE_SD, LOW, HIGH = 100.0, 25.0, 100, 200


def images(spark, folder):
    """(path, height, width, nChannels, data) of the PNG and JPEG files of a folder."""
    x = spark.read.format("image").option("dropInvalid", True).load(folder)
    return x.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").where(F.lower("origin").rlike(r"\.(png|jpe?g)\z")).withColumnRenamed("origin", "path")


def gray(a):
    """Grey values of BGR pixels, rounded."""
    if a.shape[2] == 1:
        return a[:, :, 0].astype(float)
    return np.rint(0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2])


def laplacian_variance(g):
    """Variance of the four-neighbour Laplacian; borders mirror without repeating the edge."""
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def edge_share(g, low=LOW, high=HIGH):
    """Share of edge pixels: Sobel gradients, thinning along their direction, and hysteresis between two thresholds."""
    p = np.pad(g, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    ang = np.rad2deg(np.arctan2(gy, gx)) % 180
    d = {0: (q[1:-1, :-2], q[1:-1, 2:]), 45: (q[:-2, :-2], q[2:, 2:]), 90: (q[:-2, 1:-1], q[2:, 1:-1]), 135: (q[:-2, 2:], q[2:, :-2])}
    sector = (np.floor((ang + 22.5) / 45).astype(int) % 4) * 45
    thin = np.zeros(m.shape, bool)
    for s, (a, b) in d.items():
        thin |= (sector == s) & (m > a) & (m >= b)
    strong, weak = thin & (m > high), thin & (m > low)
    while True:  # weak pixels next to an edge join it until none is left
        s = np.pad(strong, 1)
        near = np.zeros(m.shape, bool)
        for i in range(3):
            for j in range(3):
                near |= s[i : i + m.shape[0], j : j + m.shape[1]]
        grown = strong | (weak & near)
        if (grown == strong).all():
            return float(strong.mean())
        strong = grown


def quality(df, blur_threshold=BLUR_THRESHOLD):
    """(path, laplacian_variance, edge_density, verdict) of each image."""

    def run(batches):
        for b in batches:
            rows = []
            for p, h, w, c, data in zip(b.path, b.height, b.width, b.nChannels, b.data, strict=True):
                g = gray(np.frombuffer(data, np.uint8).reshape(h, w, c))
                v = laplacian_variance(g)
                rows.append((p, v, edge_share(g), "Sharp" if v >= blur_threshold else "Blurry"))
            yield pd.DataFrame(rows, columns=["path", "laplacian_variance", "edge_density", "verdict"])

    return df.mapInPandas(run, "path string, laplacian_variance double, edge_density double, verdict string")


def noisy(df):
    """(path, data): pixels with seeded noise, whose negative values wrap as unsigned bytes, added with saturation."""

    def run(batches):
        for b in batches:
            rows = []
            for p, h, w, c, data in zip(b.path, b.height, b.width, b.nChannels, b.data, strict=True):
                a = np.frombuffer(data, np.uint8)
                n = np.random.default_rng(zlib.crc32(p.encode())).normal(0, NOISE_SD, a.size).astype(np.int64).astype(np.uint8)
                rows.append((p, h, w, c, np.minimum(a.astype(np.int32) + n, 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "nChannels", "data"])

    return df.select("path", "height", "width", "nChannels", "data").mapInPandas(run, "path string, height int, width int, nChannels int, data binary")


def encode_png(a):
    """PNG bytes of an H × W × 3 RGB array."""
    h, w, _ = a.shape
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_noisy(df, folder):
    """Write noisy_<name>.png of each image into a shared folder, from the executors."""

    def save(rows):
        import os

        for r in rows:
            a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
            rgb = a[:, :, ::-1] if r["nChannels"] == 3 else np.repeat(a[:, :, :1], 3, axis=2)
            name = os.path.splitext(r["path"].rsplit("/", 1)[-1])[0]
            with open(os.path.join(folder, f"noisy_{name}.png"), "wb") as f:
                f.write(encode_png(np.ascontiguousarray(rgb)))

    noisy(df).foreachPartition(save)
