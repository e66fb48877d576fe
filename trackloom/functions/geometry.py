"""Boxes, points and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "", suffix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four columns x1, y1, x2, y2 under a prefix or suffix."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def width(b: tuple[Column, ...]) -> Column:
    return b[2] - b[0]


def height(b: tuple[Column, ...]) -> Column:
    return b[3] - b[1]


def area(b: tuple[Column, ...]) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def centre(b: tuple[Column, ...]) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def anchor_point(b: tuple[Column, ...], kind: str = "ankle") -> tuple[Column, Column]:
    """The point of a box that decides its zone: ``foot`` (bottom centre), ``center``, and for any other name two pixels above the foot."""
    cx = (b[0] + b[2]) / 2
    if kind == "foot":
        return cx, b[3]
    return (cx, (b[1] + b[3]) / 2) if kind == "center" else (cx, b[3] - 2)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...], eps: float = 1e-6) -> Column:
    """Intersection over union; ``eps`` keeps the denominator from being zero."""
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter + eps)


def containment(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The larger share of either box that lies in the other; 0 for boxes without area."""
    inter = intersection(a, b)
    share = lambda x: F.when(area(x) > 0, inter / area(x)).otherwise(0.0)
    return F.greatest(share(a), share(b))


def centre_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of the centres in units of the taller box."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by) / F.greatest(height(a), height(b), F.lit(1.0))


def frame_side(x: Column, y: Column, frame_w: Column, frame_h: Column, edge_x: float = 0.18, edge_y: float = 0.20) -> Column:
    """``left``, ``right``, ``top``, ``bottom`` or ``center`` by the band at a frame's edge; x is tested first."""
    return (
        F.when(x <= edge_x * frame_w, "left")
        .when(x >= (1 - edge_x) * frame_w, "right")
        .when(y <= edge_y * frame_h, "top")
        .when(y >= (1 - edge_y) * frame_h, "bottom")
        .otherwise("center")
    )


def side_score(exit_side: Column, entry_side: Column, same: float = 1.0, centre_: float = 0.62, opposite: float = 0.28, other: float = 0.40) -> Column:
    """How well the side of leaving fits the side of coming back."""
    pair = F.concat_ws("|", exit_side, entry_side)
    return (
        F.when(exit_side == entry_side, same)
        .when((exit_side == "center") | (entry_side == "center"), centre_)
        .when(pair.isin("left|right", "right|left", "top|bottom", "bottom|top"), opposite)
        .otherwise(other)
    )


def shape_vector(b: tuple[Column, ...], frame_w: Column, frame_h: Column) -> Column:
    """[w/h, h/H, sqrt(area)/sqrt(H W), (w+h)/(H+W)] at unit length; sides of less than a pixel count as one."""
    w, h = F.greatest(width(b), F.lit(1.0)), F.greatest(height(b), F.lit(1.0))
    parts = [w / h, h / frame_h, F.sqrt(w * h) / F.sqrt(frame_h * frame_w), (w + h) / (frame_h + frame_w)]
    norm = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return F.array(*[p / norm for p in parts])


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting: half-open in y, strict in x, edges from each vertex to the next; false for fewer than three vertices.

    ``polygon`` is an array of [x, y] arrays. Points on a left or lower edge are inside, on a right or upper one outside.
    """
    n = F.size(polygon)

    def crossing(i: Column) -> Column:
        p, q = F.get(polygon, i), F.get(polygon, F.pmod(i + 1, n))
        px, py, qx, qy = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1))
        return ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py + 1e-12) + px)

    odd = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(False), lambda odd, i: odd != crossing(i))
    return F.coalesce((n >= 3) & odd, F.lit(False))


def unit(value: Column) -> Column:
    """``value`` limited to 0..1."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def near_border(b: tuple[Column, ...], frame_w: Column, frame_h: Column, margin: float) -> Column:
    """A side that does not lie strictly within the frame less a margin (a share of its size, in whole pixels)."""
    low = lambda size: F.floor(size * margin)
    high = lambda size: F.floor(size * (1 - margin))
    return (b[0] <= low(frame_w)) | (b[1] <= low(frame_h)) | (b[2] >= high(frame_w)) | (b[3] >= high(frame_h))


def detection_quality(
    b: tuple[Column, ...], conf: Column, blur: Column, frame_w: Column, frame_h: Column, least_conf: float = 0.42, full_area: float = 0.010, margin: float = 0.015, least_blur: float = 35.0
) -> Column:
    """.36 confidence + .28 area + .20 sharpness + .16 off the border, each from 0 to 1."""
    return (
        0.36 * unit((conf - least_conf) / (1 - least_conf))
        + 0.28 * unit(area(b) / (frame_w * frame_h) / full_area)
        + 0.20 * unit((blur - least_blur) / (2 * least_blur))
        + 0.16 * F.when(near_border(b, frame_w, frame_h, margin), 0.0).otherwise(1.0)
    )


def detection_mode(b: tuple[Column, ...], quality: Column, frame_h: Column, far: float = 0.42, cautious: float = 0.62, least: float = 0.34) -> Column:
    """0 (far away or poor), 1 (use with care) or 2 (use) by how low in the frame a box ends."""
    low = b[3] / frame_h
    return F.when((quality < least) | (low < far), 0).when(low < cautious, 1).otherwise(2)


def crop_quality(
    b: tuple[Column, ...], overlap: Column, blur: Column, frame_w: Column, frame_h: Column, full_area: float = 0.008, margin: float = 0.008, least_blur: float = 24.0, most_overlap: float = 0.55
) -> Column:
    """0 for crops that are tiny, cut off and small, mostly hidden or blurred; else .40 area + .35 sharpness + .25 freedom from
    overlap, times .62 at the border. Boxes are cut to the frame in whole pixels first."""
    cut = lambda v, size: F.greatest(F.lit(0), F.least(size - 1, v.cast("bigint")))
    c = (cut(b[0], frame_w), cut(b[1], frame_h), cut(b[2], frame_w), cut(b[3], frame_h))
    share = (c[2] - c[0]) * (c[3] - c[1]) / (frame_w * frame_h)
    border = near_border(c, frame_w, frame_h, margin)
    score = (
        0.40 * unit(share / (full_area * 3.5))
        + 0.35 * unit((blur - 0.35 * least_blur) / (1.8 * least_blur))
        + 0.25 * unit(1 - overlap / (1.35 * most_overlap))
    )
    useless = (
        (c[2] <= c[0] + 6)
        | (c[3] <= c[1] + 10)
        | (share < 0.55 * full_area)
        | (border & (share < full_area))
        | (overlap > max(0.72, most_overlap + 0.10))
        | (blur < max(8.0, 0.25 * least_blur))
    )
    return F.when(useless, 0.0).otherwise(unit(score * F.when(border, 0.62).otherwise(1.0)))


def frame_flag(mean_gray: Column, std_gray: Column, white_ratio: Column) -> Column:
    """The first reason for which a frame is bad, null for a good one."""
    return (
        F.when(white_ratio >= 0.16, "white_ratio")
        .when(mean_gray >= 225, "mean_gray")
        .when((mean_gray >= 205) & (std_gray <= 45), "mean_and_std_gray")
        .when(std_gray <= 8, "std_gray")
    )


def clipped(value: Column, low: float, high: float) -> Column:
    """``value`` within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def prototype_quality(b: tuple[Column, ...], blur: Column, conf: Column, crop: Column, overlaps: Column, hidden: Column, frame_w: Column, frame_h: Column) -> Column:
    """How good a sample is for a prototype, 0 to 1: sharpness, size, distance from the border, confidence and quality of the crop, less
    what other boxes (``overlaps``) and obstacles (``hidden``) take. Missing sharpness counts as a half, other missing values as 0.58."""
    x1, y1, x2, y2 = b
    w, h = F.greatest(F.lit(1.0), frame_w), F.greatest(F.lit(1.0), frame_h)
    area = F.greatest(F.lit(1.0), x2 - x1) * F.greatest(F.lit(1.0), y2 - y1) / (w * h)
    zero = F.lit(0.0)
    margin = F.least(F.greatest(zero, x1), F.greatest(zero, y1), F.greatest(zero, w - F.least(w, x2)), F.greatest(zero, h - F.least(h, y2)))
    terms = {
        0.30: F.coalesce(clipped((blur - 24.0) / 180.0, 0.0, 1.0), F.lit(0.5)),
        0.23: clipped((area - 0.0022) / 0.016, 0.0, 1.0),
        0.16: clipped(margin / (0.06 * F.least(w, h) + 1e-6), 0.0, 1.0) + F.coalesce(clipped((conf - 0.24) / 0.56, 0.0, 1.0), F.lit(0.58)),
        0.15: F.coalesce(clipped(crop, 0.0, 1.0), F.lit(0.58)),
    }
    lost = clipped(0.24 * F.greatest(zero, F.coalesce(overlaps, zero)), 0.0, 0.55) + clipped(0.28 * F.greatest(zero, F.coalesce(hidden, zero)), 0.0, 0.45)
    total = F.lit(0.0)
    for weight, term in terms.items():
        total = total + weight * term
    return clipped(total - lost, 0.0, 1.0)


def render_flag(mean_gray: Column, std_gray: Column, white: Column, bright: Column, top_white: Column, bottom_white: Column, detail: Column) -> Column:
    """Whether a frame is not worth showing: washed out, without contrast, white in one half and not clean in the other, or bright without detail."""
    washed = (white >= 0.16) | ((mean_gray >= 205) & (std_gray <= 45)) | (mean_gray >= 225) | (std_gray <= 8)
    band = (F.greatest(top_white, bottom_white) >= 0.55) & (F.least(top_white, bottom_white) >= 0.12)
    return washed | band | ((bright >= 0.62) & (detail <= 28))
