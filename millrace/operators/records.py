"""Records of the nine visual tasks: questions, choices, and the geometry of their distractors. Draws depend on a key alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The tasks' questions; {} stands for what is asked for.
QUESTIONS = {
    "counting": "How many {} are in the image? Provide a single integer answer.",
    "jigsaw": "The top image has its bottom-right quadrant blacked out. Which of the two patches below is the correct missing patch? (A) (B)",
    "object_localization": "Which bounding box most accurately localizes the {} in the image? (A) (B)",
    "visual_correspondence": "A point is circled on the first image, labeled with REF. We change the camera position or lighting and shoot the second image. You are given multiple red-circled points on the second image, "
    'choices of "A, B, C, D" are drawn beside each circle. Which point on the second image corresponds to the point in the first image? Select from the following options.\n(A) Point A\n(B) Point B\n(C) Point C\n(D) Point D',
    "semantic_correspondence": "Humans can find corresponding points for different objects in the same category. For instance, if there are images of two different cats, then the left ear tip of one cat corresponds to the left ear tip "
    "of the other cat, and the right front paw of one cat corresponds to the right front paw of the other cat.\nGiven the following two images, a reference point is annotated on the first image, labeled with REF. You are given "
    'multiple red-circled points on the second image, choices of "A, B, C, D" are drawn beside each circle. Select between the choices on the second image and find the corresponding point for the reference point. '
    "Which point is corresponding to the reference point? Select from the following choices.\n(A) Point A\n(B) Point B\n(C) Point C\n(D) Point D",
    "functional_correspondence": 'Humans can find corresponding points for the same action between different objects. For instance, if a person uses a hammer to "Mash Pound", then the handle of the hammer will be the corresponding '
    "point to the handle of the pot because they serve the same function for the action — to hold; and the bottom of the pot will be the corresponding point to the face of the hammer because they both mash the other object.\n"
    "Given the following two images, a reference point is annotated on the first image, labeled with REF. You are given multiple red-circled points on the right image, "
    'choices of "A, B, C, D" are drawn beside each circle. Select from the choices on the second image and find the corresponding point for the reference point for the action: "{}". '
    "Which point is corresponding to the reference point? Select from the following choices.\n(A) Point A\n(B) Point B\n(C) Point C\n(D) Point D",
    "relative_reflectance": "Two points are marked in the image: Point A (red) and Point B (blue). Which statement about their relative surface reflectance is correct? (A) A is darker than B (B) B is darker than A (C) Same reflectance",
    "art_style": "Which painting shares the same art style as the reference painting (top)? (A) (B)",
    "visual_similarity": "Which image is more visually similar to the reference image (top)? (A) (B)",
}
CANVAS, HEIGHTS, SPARE = 400, (170, 230), 20


def question(task: Column, asked: Column) -> Column:
    """The question of a task; null for a task that is not known."""
    texts = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])
    return F.replace(F.try_element_at(texts, task), F.lit("{}"), F.coalesce(asked, F.lit("objects")))


def record(question_: Column, truth: Column, choices: Column, image: Column, task: Column, split: Column) -> Column:
    """A multiple-choice record; a single letter as truth goes in parentheses."""
    letter = F.when(truth.rlike(r"^\p{L}$"), F.concat(F.lit("("), truth, F.lit(")"))).otherwise(truth)
    return F.struct(question_.alias("question"), letter.alias("ground_truth"), F.lit("mcq").alias("answer_type"), F.array_join(choices, ", ").alias("choices"), F.array(image).alias("images"),
                    task.alias("dataset_name"), split.alias("split"))


def draw(key: Column, what: str, n: Column, lo: Column, hi: Column) -> Column:
    """A whole number from lo to hi, by a hash of the key, what it is for, and the number of the try."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(what), key.cast("string"), n.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    return lo + F.floor(u * (hi - lo + 1)).cast("long")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def apart(points: Column, target: Column, width: Column, height: Column, margin: float, least: float, most: int = 3) -> Column:
    """The first ``most`` of the points (x, y) that lie inside the margin and ``least`` away from the target and from each other."""
    inside = lambda p: p["x"].between(F.lit(margin), width - margin) & p["y"].between(F.lit(margin), height - margin)

    def step(kept: Column, p: Column) -> Column:
        good = (F.size(kept) <= most) & inside(p) & F.forall(kept, lambda k: distance(k["x"], k["y"], p["x"], p["y"]) >= least)
        return F.when(good, F.array_append(kept, p)).otherwise(kept)

    return F.slice(F.aggregate(points, F.array(target), step), F.lit(2), F.lit(most))


def canvas(key: Column, width: Column, height: Column) -> Column:
    """A canvas (x, y, w, h) within an image; null where it does not fit."""
    h = draw(key, "h", F.lit(0), F.lit(HEIGHTS[0]), F.lit(HEIGHTS[1]))
    return F.when((width >= CANVAS + SPARE) & (height >= h + SPARE), F.struct(draw(key, "x", F.lit(0), F.lit(0), width - CANVAS).alias("x"), draw(key, "y", F.lit(0), F.lit(0), height - h).alias("y"), F.lit(CANVAS).cast("long").alias("w"), h.alias("h")))


def other_patch(key: Column, width: Column, height: Column, truth: Column, on: Column, tries: int = 50) -> Column:
    """The first patch of the truth's size, of ``tries`` drawn in the image, that meets the canvas, not the truth, and whose centre
    is half the canvas's shorter side away from the truth's; null where none does. Boxes are (x, y, w, h)."""
    boxes = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda n: F.struct(draw(key, "dx", n, F.lit(0), width - truth["w"]).alias("x"), draw(key, "dy", n, F.lit(0), height - truth["h"]).alias("y"), truth["w"].alias("w"), truth["h"].alias("h")))
    meets = lambda a, b: (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])
    middle = lambda b: (b["x"] + b["w"] / 2, b["y"] + b["h"] / 2)
    good = F.filter(boxes, lambda d: meets(d, on) & ~meets(d, truth) & (distance(*middle(d), *middle(truth)) >= 0.5 * F.least(on["w"], on["h"])))
    return F.get(good, F.lit(0))


def disk_mean(pixels: Column, width: int, height: int, cx: Column, cy: Column, radius: int, linear) -> Column:
    """The mean of ``linear`` (pixel -> luminance) over the pixels of a disk, clipped at the borders of a row-major image; null for none."""
    ys = F.filter(F.sequence(cy - radius, cy + radius), lambda y: (y >= 0) & (y < height))
    rows = F.transform(ys, lambda y: F.transform(F.filter(F.sequence(cx - radius, cx + radius), lambda x: (x >= 0) & (x < width) & ((x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius)), lambda x: linear(F.get(pixels, (y * width + x).cast("int")))))
    values = F.flatten(rows)
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))
