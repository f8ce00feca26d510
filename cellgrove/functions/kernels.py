"""Kernel tables: small weight dictionaries built on the driver from parameters."""

from __future__ import annotations

import math

Kernel = dict[tuple[int, int], float]


def box(k: int) -> Kernel:
    r = k // 2
    return {(dy, dx): 1.0 / (k * k) for dy in range(-r, k - r) for dx in range(-r, k - r)}


def box_line(k: int) -> dict[int, float]:
    r = k // 2
    return {d: 1.0 / k for d in range(-r, k - r)}


def gaussian_line(sigma: float, truncate: float = 4.0, radius: int | None = None) -> dict[int, float]:
    r = radius if radius is not None else max(1, math.ceil(truncate * sigma - 0.5))
    raw = {d: math.exp(-d * d / (2.0 * sigma * sigma)) for d in range(-r, r + 1)}
    total = sum(raw.values())
    return {d: v / total for d, v in raw.items()}


def gaussian(sigma: float, radius: int | None = None) -> Kernel:
    line = gaussian_line(sigma, radius=radius)
    return {(a, b): u * v for a, u in line.items() for b, v in line.items()}


def difference(a: Kernel, b: Kernel) -> Kernel:
    return {k: a.get(k, 0.0) - b.get(k, 0.0) for k in set(a) | set(b)}


def sobel(axis: str) -> Kernel:
    smooth, slope = {-1: 1.0, 0: 2.0, 1: 1.0}, {-1: -1.0, 1: 1.0}
    if axis == "x":
        return {(a, b): s * d for a, s in smooth.items() for b, d in slope.items()}
    return {(a, b): d * s for a, d in slope.items() for b, s in smooth.items()}


def gaussian_derivative(sigma: float, order_y: int, order_x: int, radius: int | None = None) -> Kernel:
    """Sampled derivative of a Gaussian (orders 0 to 2 per axis)."""
    line = gaussian_line(sigma, radius=radius)
    s2 = sigma * sigma
    factor = {0: lambda t: 1.0, 1: lambda t: t / s2, 2: lambda t: t * t / (s2 * s2) - 1.0 / s2}
    return {
        (a, b): u * factor[order_y](a) * v * factor[order_x](b)
        for a, u in line.items()
        for b, v in line.items()
    }


def balanced(kernel: Kernel) -> Kernel:
    """Shift to zero mean, scale to unit absolute sum."""
    mean = sum(kernel.values()) / len(kernel)
    shifted = {k: v - mean for k, v in kernel.items()}
    norm = sum(abs(v) for v in shifted.values())
    return {k: v / norm for k, v in shifted.items()} if norm > 0 else shifted


def gabor(size: int, sigma: float, angle_deg: float, wavelength: float, gamma: float) -> Kernel:
    """Cosine carrier under an elliptical Gaussian, zero mean, unit absolute sum."""
    r, t = size // 2, math.radians(angle_deg)
    kernel = {}
    for y in range(-r, r + 1):
        for x in range(-r, r + 1):
            along, across = x * math.cos(t) + y * math.sin(t), y * math.cos(t) - x * math.sin(t)
            envelope = math.exp(-(along**2 + (gamma * across) ** 2) / (2 * sigma**2))
            kernel[(-y, -x)] = envelope * math.cos(2 * math.pi * along / wavelength)
    return balanced(kernel)


def matched_line(size: int, sigma: float, angle_deg: float) -> Kernel:
    """Gaussian profile across a line of the window's length, zero mean."""
    r, t = size // 2, math.radians(angle_deg)
    cells = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)]
    profile = {
        (y, x): (
            math.exp(-((y * math.cos(t) - x * math.sin(t)) ** 2) / (2 * sigma**2))
            if abs(x * math.cos(t) + y * math.sin(t)) <= r
            else 0.0
        )
        for y, x in cells
    }
    return balanced(profile)


def ellipse(k: int) -> list[tuple[int, int]]:
    """Elliptical structuring element of width k: row y spans round(r * sqrt(1 - y2/r2))."""
    r = k // 2
    cells = []
    for dy in range(-r, k - r):
        half = round(r * math.sqrt(max(0.0, r * r - dy * dy)) / r) if r else 0
        cells += [(dy, dx) for dx in range(-half, half + 1)]
    return cells


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, dx) for dy in range(-r, k - r) for dx in range(-r, k - r)]


def line_element(length: int, angle_deg: float) -> list[tuple[int, int]]:
    """Cells of a centred line segment, one per step along its longer axis."""
    half = (length - 1) / 2
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    steps = [i - half for i in range(length)]
    reach = max(abs(c), abs(s))
    return sorted({(round(-t * s / reach), round(t * c / reach)) for t in steps})
