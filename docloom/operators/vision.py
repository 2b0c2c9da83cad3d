"""Marks and images: pluggable kernels over binary files, and kernels that numpy alone can do.

A kernel takes a numpy image (height, width, 3; blue, green, red) and runs inside Arrow batches.
Recognisers and PDF rendering need libraries that are not part of this package; they plug in as
kernels of their own. Files that are missing or that no decoder reads give marks of status
``not_implemented`` (detection) or an error per file (kernels), never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import Registry
from . import imaging as im

# Orientation and skew.
ROTATED = 1.6
LINE_KERNEL, LINE_TIMES, LEAST_LINE, LEAST_SKEW = (30, 3), 2, 100, 0.5
# Contrast and noise.
LOW_CONTRAST, CLIP_LIMIT, TILES = 60.0, 2.0, 8
NOISE_DIAMETER, NOISE_COLOUR, NOISE_SPACE = 5, 50.0, 50.0
# Colours of stamps (hue of 180: from, to; least saturation and value), their sizes and scores.
INKS = ((95, 135, 45), (135, 165, 45), (0, 10, 50), (165, 180, 50))
STAMP_AREA, STAMP_ASPECT, STAMP_SIDE, STAMP_DENSITY = (600.0, 120_000.0), (0.5, 2.5), 25, 0.08
STAMP_SCORE, STAMP_ROUND, STAMP_LIMITS = (0.65, 0.4, 0.2), 0.5, (0.65, 0.96)
# Signatures: where they are, their sizes, strokes and scores; lines of tables to take out.
SIGNATURE_FROM, SIGNATURE_AREA, SIGNATURE_ASPECT, SIGNATURE_SIDES = 0.5, (400.0, 40_000.0), (1.0, 7.0), (35, 15)
COMPLEX, SIGNATURE_SCORE, SIGNATURE_LIMITS, TABLE_LINE = 18.0, (0.60, 0.35), (0.60, 0.95), 25
# What ranks candidates (weight of the score, of the area), confidences where nothing is found.
RANK = {"signature": (0.6, 0.4), "stamp": (0.5, 0.5)}
NOTHING, NO_COLOUR = 0.15, 0.10
CONDITIONS = ("clean", "blur", "noise", "rotation_90", "rotation_180", "low_contrast", "downscale")

grey = im.grey


def load_image(source: str | np.ndarray) -> np.ndarray:
    """A copy of an image, or the image of a file that ``imaging`` decodes."""
    if isinstance(source, np.ndarray):
        return source.copy()
    if not isinstance(source, str):
        raise TypeError(f"Expected file path str or np.ndarray, got {type(source)}")
    try:
        return im.decode_png(Path(source).read_bytes())
    except (OSError, ValueError) as e:
        raise FileNotFoundError(f"Unable to read image at path: {source}") from e


def orientation(image: np.ndarray) -> int:
    """90 where ink varies far more from column to column than from row to row, else 0."""
    mask = im.ink(image)
    return 90 if mask.sum(0).var() > ROTATED * mask.sum(1).var() else 0


def skew(image: np.ndarray) -> float:
    """The median angle of the text lines, in degrees; 0 below half a degree or without lines."""
    lines = im.dilate(im.ink(image), im.box(*LINE_KERNEL), LINE_TIMES)
    angles = []
    for part in im.outer(lines):
        if part["area"] >= LEAST_LINE:
            angle = im.least_box_angle(part["boundary"])
            angle = 90 - angle if angle > 45 else -angle
            if abs(angle) < 45:
                angles.append(angle)
    found = float(np.median(angles)) if angles else 0.0
    return found if abs(found) >= LEAST_SKEW else 0.0


def correct_skew(image: np.ndarray, angle: float | None = None) -> tuple[np.ndarray, float]:
    """The image turned by its skew, and the angle."""
    angle = skew(image) if angle is None else angle
    return (image, 0.0) if abs(angle) < LEAST_SKEW else (im.rotated(image, angle), angle)


def enhance_contrast(image: np.ndarray, limit: float = CLIP_LIMIT, tiles: int = TILES) -> np.ndarray:
    """Adaptive equalisation of the lightness, with limited contrast."""
    if image.ndim == 2:
        return im.equalised(image, limit, tiles)
    lab = im.to_lab(image)
    light = np.clip(np.floor(lab[..., 0] * 2.55 + 0.5), 0, 255).astype(np.uint8)
    lab[..., 0] = im.equalised(light, limit, tiles) / 2.55
    return im.from_lab(lab)


def denoise(image: np.ndarray, diameter: int = NOISE_DIAMETER, colour: float = NOISE_COLOUR, space: float = NOISE_SPACE) -> np.ndarray:
    """Noise smoothed away, edges kept."""
    return im.bilateral(image, diameter, colour, space)


def preprocess(source: str | np.ndarray, *, deskew: bool = True, contrast: bool = True, noise: bool = True) -> tuple[np.ndarray, dict]:
    """The image made ready for a recogniser, and what was done: orientation, skew, contrast, noise."""
    image = load_image(source)
    done = {"original_shape": list(image.shape), "skew_angle_corrected": 0.0, "orientation_angle_corrected": 0, "clahe_applied": False, "denoise_applied": False}
    if orientation(image) == 90:
        image, done["orientation_angle_corrected"] = np.rot90(image, -1).copy(), 90
    if deskew:
        image, angle = correct_skew(image)
        done["skew_angle_corrected"] = round(angle, 2)
    if contrast and float(grey(image).std()) < LOW_CONTRAST:
        image, done["clahe_applied"] = enhance_contrast(image), True
    if noise:
        image, done["denoise_applied"] = denoise(image), True
    return image, done | {"final_shape": list(image.shape)}


def hue_saturation_value(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (of 180), saturation and value (of 255), as whole numbers."""
    b, g, r = (image[..., k].astype(float) for k in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(high > low, high - low, 1)
    hue = np.where(high == r, (g - b) / span % 6, np.where(high == g, (b - r) / span + 2, (r - g) / span + 4)) * 30
    hue = np.where(high > low, np.floor(hue + 0.5) % 180, 0)
    return hue, np.floor(np.where(high > 0, (high - low) / np.maximum(high, 1) * 255, 0) + 0.5), high


def stamp_mask(image: np.ndarray) -> np.ndarray:
    """Pixels in a stamp's colours: blue, purple, red."""
    coloured = (image[..., 1:] != image[..., :1]).any(-1)  # grey ones have no saturation
    h, s, v = hue_saturation_value(image[coloured])
    mask = np.zeros(image.shape[:2], bool)
    mask[coloured] = np.logical_or.reduce([(h >= a) & (h <= b) & (s >= least) & (v >= least) for a, b, least in INKS])
    return mask


def best_candidate(kind: str, candidates: list[tuple[tuple, float, float]]) -> tuple[tuple, float, float]:
    """Of (box, score, area) the one that ranks first by score and size; the first of equal ones."""
    by_score, by_area = RANK[kind]
    most = (SIGNATURE_AREA if kind == "signature" else STAMP_AREA)[1]
    return max(candidates, key=lambda c: c[1] * by_score + c[2] / most * by_area)


def _mark(kind: str, status: str, confidence: float, box=None, **details) -> dict:
    return {"mark_type": kind, "status": status, "present": status == "detected", "confidence": round(confidence, 4), "bbox": None if box is None else [float(x) for x in box], "details": details}


def _result(kind: str, candidates: list, **details) -> dict:
    if not candidates:
        return _mark(kind, "not_detected", NOTHING, **details)
    box, score, _ = best_candidate(kind, candidates)
    return _mark(kind, "detected", score, box, candidates=len(candidates), **details)


def find_stamp(image: np.ndarray) -> dict:
    """The mark of the most prominent stamp: a coloured region by its size, aspect, density and roundness."""
    if image.ndim != 3 or image.shape[2] != 3:
        return _mark("stamp", "not_detected", NO_COLOUR, reason="no colour")
    mask, found = stamp_mask(image), []
    for part in im.outer(im.closed(mask, im.ellipse(7), 2)):
        x, y, w, h = part["box"]
        if not (STAMP_AREA[0] <= part["area"] <= STAMP_AREA[1] and STAMP_ASPECT[0] <= w / h <= STAMP_ASPECT[1] and min(w, h) >= STAMP_SIDE):
            continue
        density = float(mask[y : y + h, x : x + w].mean())
        if density >= STAMP_DENSITY:
            roundness = 4 * np.pi * part["area"] / (part["perimeter"] ** 2 + 1e-5)
            base, by_density, by_round = STAMP_SCORE
            score = base + density * by_density + (roundness if roundness <= 1 else STAMP_ROUND) * by_round
            found.append(((x, y, x + w, y + h), float(np.clip(score, *STAMP_LIMITS)), part["area"]))
    return _result("stamp", found, method="colour_regions")


def find_signature(image: np.ndarray) -> dict:
    """The mark of the most prominent signature: connected strokes in the lower half with a long outline."""
    top = int(image.shape[0] * SIGNATURE_FROM)
    dark = im.local_ink(grey(image[top:]))
    strokes = dark & ~im.opened(dark, im.box(TABLE_LINE, 1)) & ~im.opened(dark, im.box(1, TABLE_LINE))
    found = []
    for part in im.outer(im.dilate(strokes, im.ellipse(5))):
        x, y, w, h = part["box"]
        complexity = part["perimeter"] ** 2 / (part["area"] + 1e-5)
        fits = SIGNATURE_AREA[0] <= part["area"] <= SIGNATURE_AREA[1] and SIGNATURE_ASPECT[0] <= w / h <= SIGNATURE_ASPECT[1] and w >= SIGNATURE_SIDES[0] and h >= SIGNATURE_SIDES[1]
        if fits and complexity >= COMPLEX:
            score = float(np.clip(SIGNATURE_SCORE[0] + complexity / 100 * SIGNATURE_SCORE[1], *SIGNATURE_LIMITS))
            found.append(((x, top + y, x + w, top + y + h), score, part["area"]))
    return _result("signature", found, method="stroke_complexity")


DETECTORS: dict[str, Callable[[np.ndarray], dict]] = {"signature": find_signature, "stamp": find_stamp}


def detect_mark(kind: str, source: str | np.ndarray) -> dict:
    """A detector's mark; ``not_implemented`` for text files and what cannot be read."""
    try:
        if isinstance(source, str) and source.lower().endswith(".txt"):
            raise FileNotFoundError(source)
        image = load_image(source)
    except (FileNotFoundError, TypeError):
        return stub_mark(kind)
    return DETECTORS[kind](image)


def stub_mark(kind: str) -> dict:
    """The mark where detection is off."""
    return _mark(kind, "not_implemented", 0.0)


def manual_mark(kind: str, present: bool, bbox: list[float] | None = None, confidence: float = 1.0, status: str = "detected") -> dict:
    """A mark that a person has given."""
    return _mark(kind, "detected", confidence, bbox) | {"present": present, "status": status if present else "not_detected"}


def degrade(image: np.ndarray, kind: str, seed: int = 0) -> np.ndarray:
    """The robustness conditions: ``CONDITIONS``; anything else leaves the image as it is."""
    if kind == "blur":
        return im.blur(image, 9, 3.0)
    if kind == "noise":
        return np.clip(image + np.random.default_rng(seed).normal(0, 20, image.shape), 0, 255).astype(np.uint8)
    if kind in ("rotation_90", "rotation_180"):
        return np.rot90(image, -1 if kind == "rotation_90" else 2).copy()
    if kind == "low_contrast":
        return np.clip(image * 0.45 + 50, 0, 255).astype(np.uint8)
    if kind == "downscale":
        return im.halved_and_back(image)
    return image.copy()


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,pdf}") -> DataFrame:
    """(path, content) of files by extension."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def apply_kernel(images: DataFrame, decode: Callable[[bytes], list[np.ndarray]] | None, kernel: Callable[[np.ndarray], dict], schema: str, max_pages: int | None = None) -> DataFrame:
    """Rows (path, page, *schema, error) of a kernel over every page of every file; ``decode`` renders the pages.

    Without ``decode`` files are PNG. A file that cannot be decoded is one row with page 0 and the error.
    """
    names = ["path", "page", *[c.split()[0] for c in schema.split(", ")], "error"]
    pages_of = decode or (lambda content: [im.decode_png(content)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, "page": k, **kernel(page)} for k, page in enumerate(pages_of(content)[:max_pages], 1)]
                except Exception as e:
                    rows.append({"path": path, "page": 0, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return images.mapInPandas(run, f"path string, page int, {schema}, error string")


MARK = "struct<name:string,mark_type:string,status:string,present:boolean,confidence:double>"


def text_marks(docs: DataFrame, registry: Registry) -> DataFrame:
    """Add ``marks`` of documents without an image: those that the schema names, not detected."""
    from .documents import by_type

    known = ("signature", "stamp")

    def of(s):
        made = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("mark_type"), F.lit("not_implemented").alias("status"), F.lit(False).alias("present"), F.lit(0.0).alias("confidence")) for n, t, _ in s.marks if t in known]
        return (F.array(*made) if made else F.array()).cast(f"array<{MARK}>")

    return docs.withColumn("marks", by_type(registry, F.col("document_type"), of))


def manual_marks(docs: DataFrame, given: DataFrame) -> DataFrame:
    """Add ``marks`` that a person has set: ``given`` (doc_id, name, mark_type, present, confidence)."""
    made = given.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name", "mark_type", F.lit("manual").alias("status"), "present", "confidence"))).cast(f"array<{MARK}>").alias("marks"))
    return docs.join(made, "doc_id", "left").withColumn("marks", F.coalesce("marks", F.array().cast(f"array<{MARK}>")))
