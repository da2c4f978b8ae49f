"""A small baseline JPEG reader, independent of the writer: what exports hold is checked by it."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def read_jpeg(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of a baseline file with three components."""
    at, quant, codes, parts, height, width = 2, {}, {}, [], 0, 0
    while True:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant[body[0]] = list(body[1:65])
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xC4:
            table, code, k = {}, 0, 17
            for length, n in enumerate(body[1:17], 1):
                for _ in range(n):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0]] = table
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    raw = data[at:-2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in raw)
    pos = 0

    def symbol(table):
        nonlocal pos
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(bits[pos])
            pos += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def number(size):
        nonlocal pos
        if not size:
            return 0
        v = int(bits[pos : pos + size], 2)
        pos += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    n = np.arange(8)
    basis = np.where(n[:, None] == 0, 0.5**0.5, 1) * 0.5 * np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16)
    fx, fy = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * fx)), -(-height // (8 * fy))
    planes = {p[0]: np.zeros((down * p[2] * 8, across * p[1] * 8)) for p in parts}
    last = dict.fromkeys(planes, 0)
    for my in range(down):
        for mx in range(across):
            for name, h, v, q in parts:
                for dy in range(v):
                    for dx in range(h):
                        z = [0] * 64
                        last[name] += number(symbol(codes[tables[name] >> 4]))
                        z[0], k = last[name], 1
                        while k < 64:
                            s = symbol(codes[16 | tables[name] & 15])
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                z[k] = number(s & 15)
                            k += 1
                        freq = np.zeros(64)
                        for i in range(64):
                            freq[order[i]] = z[i] * quant[q][i]
                        y, x = (my * v + dy) * 8, (mx * h + dx) * 8
                        planes[name][y : y + 8, x : x + 8] = basis.T @ freq.reshape(8, 8) @ basis + 128
    y, cb, cr = (planes[p[0]].repeat(fy // p[2], 0).repeat(fx // p[1], 1)[:height, :width] for p in parts)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(int)


def read_jpegs(files: DataFrame) -> DataFrame:
    """image_id, row, col, r, g, b of baseline files (image_id, content)."""

    def run(batches):
        for batch in batches:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pixels = read_jpeg(content)
                row, col = np.divmod(np.arange(pixels.shape[0] * pixels.shape[1], dtype=np.int32), np.int32(pixels.shape[1]))
                flat = pixels.reshape(-1, 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), image)), pa.array(row), pa.array(col), *[pa.array(flat[:, k].copy()) for k in range(3)]], ["image_id", "row", "col", "r", "g", "b"])

    return files.select("image_id", "content").mapInArrow(run, "image_id long, row int, col int, r int, g int, b int")
