"""Geometry of poses over numpy arrays, a row a frame: what ``geometry`` says as columns, for the step that needs nearly all of it at once.

As columns that step is one generated method too long for the JVM to compile. A point is a pair of arrays; NaN means not measured.
"""

from __future__ import annotations

import numpy as np

from plumbline.functions.geometry import HEAD, HEAD_FALLBACK, LIMBS, MIN_SEGMENT_L, TRUNK

Point = tuple[np.ndarray, np.ndarray]


def first_known(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(a), b, a)


def side_mean(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """GEO3, GEO4: mean of both sides, else the one that is known."""
    return first_known(first_known((left + right) / 2, left), right)


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def along(a: Point, b: Point, part: float) -> Point:
    """GEO15."""
    return a[0] + (b[0] - a[0]) * part, a[1] + (b[1] - a[1]) * part


def distance(a: Point, b: Point) -> np.ndarray:
    """GEO8."""
    return np.hypot(*minus(a, b))


def angle_between(a: Point, b: Point) -> np.ndarray:
    """GEO5."""
    cross, dot = a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1]
    long = (np.hypot(*a) > MIN_SEGMENT_L) & (np.hypot(*b) > MIN_SEGMENT_L)
    return np.where(long, np.degrees(np.arctan2(np.abs(cross), dot)), np.nan)


def angle_at(first: Point, middle: Point, last: Point) -> np.ndarray:
    """GEO6."""
    return angle_between(minus(first, middle), minus(last, middle))


def sign(x: np.ndarray) -> np.ndarray:
    """1 or -1, not known for 0."""
    return np.where(x > 0, 1.0, np.where(x < 0, -1.0, np.nan))


def line_side(origin: Point, end: Point, p: Point) -> np.ndarray:
    dx, dy = minus(end, origin)
    size = np.hypot(dx, dy)
    return np.where(size > MIN_SEGMENT_L, (dx * (p[1] - origin[1]) - dy * (p[0] - origin[0])) / size, np.nan)


def banana(shoulders: Point, hips: Point, ankles: Point, nose: Point) -> np.ndarray:
    """GEO11."""
    return line_side(shoulders, ankles, hips) * sign(line_side(shoulders, ankles, nose))


def centre_of_mass(joints: dict[str, Point], shoulders: Point, hips: Point) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """GEO14, GEO16: x, y and whether every part is known; a limb that is not known copies its counterpart."""
    either = lambda a, b: tuple(first_known(p, q) for p, q in zip(a, b, strict=True))
    parts = [(either(joints["nose"], along(hips, shoulders, 1 + HEAD_FALLBACK)), HEAD[1]), (along(shoulders, hips, TRUNK[2]), TRUNK[1])]
    for _, near, far, mass, part in LIMBS:
        left, right = (along(joints[f"{s}_{near}"], joints[f"{s}_{far}"], part) for s in ("left", "right"))
        parts += [(either(left, right), mass), (either(right, left), mass)]
    mass, x, y, complete = 0.0, 0.0, 0.0, True
    for p, m in parts:
        known = ~np.isnan(p[0])
        mass, complete = mass + np.where(known, m, 0.0), complete & known
        x, y = x + np.where(known, p[0] * m, 0.0), y + np.where(known, p[1] * m, 0.0)
    mass = np.where(mass > 0, mass, np.nan)
    return x / mass, y / mass, complete
