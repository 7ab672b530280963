"""Per-image numpy helpers; images are height x width x 3 RGB arrays of floats in 0..255."""

from __future__ import annotations

import numpy as np

# Luminance weights, channel statistics of the encoder's training images.
LUMA = np.array([0.299, 0.587, 0.114])
CHANNEL_MEAN = np.array([0.485, 0.456, 0.406])
CHANNEL_STD = np.array([0.229, 0.224, 0.225])


def from_struct(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Image-source row (BGR, BGRA or grey bytes) to RGB."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def to_bytes(img: np.ndarray) -> bytes:
    """RGB to the BGR bytes of the image source."""
    return np.ascontiguousarray(as_bytes(img)[:, :, ::-1]).tobytes()


def as_bytes(img: np.ndarray) -> np.ndarray:
    """Cut to whole bytes; the tolerance keeps a whole number whole after rounding noise."""
    return (np.clip(img, 0, 255) + 1e-6).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    return img @ LUMA


# --- geometry ---------------------------------------------------------------------------------


def _resample_weights(size: int, target: int) -> np.ndarray:
    """Rows of a triangle filter that widens when shrinking (bilinear with antialiasing)."""
    ratio = size / target
    reach = max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    away = np.abs((np.arange(size) + 0.5)[None, :] - centre[:, None]) / reach
    weights = np.maximum(1.0 - away, 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    if img.shape[:2] == (height, width):
        return img
    rows, cols = _resample_weights(img.shape[0], height), _resample_weights(img.shape[1], width)
    return np.einsum("hy,yxc,wx->hwc", rows, img, cols, optimize=True)


def box_pixels(height: int, width: int, box: dict) -> tuple[int, int, int, int]:
    """Relative box to (top, bottom, left, right) pixels, unclipped."""
    edges = [box.get("y_min", 0.0) * height, box.get("y_max", 1.0) * height,
             box.get("x_min", 0.0) * width, box.get("x_max", 1.0) * width]
    return tuple(int(e) for e in edges)


def crop_letterbox(img: np.ndarray, box: dict | None) -> np.ndarray:
    """Relative crop fitted onto a black canvas of the target size; a degenerate box changes nothing."""
    if not box:
        return img
    h, w = img.shape[:2]
    top, bottom, left, right = box_pixels(h, w, box)
    part = img[max(top, 0):min(bottom, h), max(left, 0):min(right, w)]
    if part.size == 0 or bottom <= top or right <= left:
        return img
    tall, wide = int(box.get("target_height", h)), int(box.get("target_width", w))
    if not box.get("keep_aspect", True):
        return resize(part, tall, wide)
    scale = min(tall / part.shape[0], wide / part.shape[1])
    fit_h, fit_w = (max(1, round(n * scale)) for n in part.shape[:2])
    canvas = np.zeros((tall, wide, 3))
    y, x = (tall - fit_h) // 2, (wide - fit_w) // 2
    canvas[y:y + fit_h, x:x + fit_w] = resize(part, fit_h, fit_w)
    return canvas


def crop_roi(img: np.ndarray, box: dict | None) -> np.ndarray:
    """Relative crop that always keeps at least one pixel."""
    if not box:
        return img
    h, w = img.shape[:2]
    top, bottom, left, right = box_pixels(h, w, box)
    top, left = np.clip(top, 0, h - 1), np.clip(left, 0, w - 1)
    return img[top:max(top + 1, min(bottom, h)), left:max(left + 1, min(right, w))]


def _sample(img: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float) -> np.ndarray:
    """Bilinear lookup at fractional positions; outside the image is ``fill``."""
    h, w = img.shape[:2]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]

    def at(yy, xx):
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        out = img[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
        return np.where(ok[..., None], out, fill)

    upper = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    lower = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return upper * (1 - fy) + lower * fy


def rotate(img: np.ndarray, degrees: float, fill: float) -> np.ndarray:
    h, w = img.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    cy, cx, t = (h - 1) / 2, (w - 1) / 2, np.deg2rad(degrees)
    dy, dx = y - cy, x - cx
    return _sample(img, cy + dy * np.cos(t) + dx * np.sin(t), cx + dx * np.cos(t) - dy * np.sin(t), fill)


def trapezoid(img: np.ndarray, offset: float, fill: float) -> np.ndarray:
    """Top edge narrowed (offset > 0) or bottom edge narrowed by ``|offset|`` pixels on either side."""
    h, w = img.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    along = y / max(h - 1, 1)
    inset = offset * (1 - along) if offset > 0 else -offset * along
    span = np.maximum(w - 1 - 2 * inset, 1.0)
    return _sample(img, y, (x - inset) / span * (w - 1), fill)


# --- filters ----------------------------------------------------------------------------------


def _convolve(img: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    half = len(kernel) // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(3)]
    padded = np.pad(img, pad, mode="edge")
    n = img.shape[axis]
    return sum(k * np.take(padded, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))


def gaussian_blur(img: np.ndarray, sigma: float, half: int | None = None) -> np.ndarray:
    half = max(1, int(np.ceil(3 * sigma))) if half is None else half
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return _convolve(_convolve(img, kernel, 0), kernel, 1)


def smooth(img: np.ndarray) -> np.ndarray:
    """3x3 smoothing with weight 5 in the centre; border pixels stay."""
    if min(img.shape[:2]) < 3:
        return img
    box = _convolve(_convolve(img, np.ones(3), 0), np.ones(3), 1)
    out = img.copy()
    out[1:-1, 1:-1] = ((box + 4 * img) / 13)[1:-1, 1:-1]
    return out


def laplacian_variance(lum: np.ndarray) -> float:
    """Variance of the 5-point Laplacian over inner pixels; 0 when there are none."""
    if min(lum.shape) < 3:
        return 0.0
    second = np.diff(lum, 2, axis=0)[:, 1:-1] + np.diff(lum, 2, axis=1)[1:-1, :]
    return float(second.var())


def statistics(img: np.ndarray) -> dict[str, float]:
    """Luminance mean and deviation, channel means, sharpness; all on the 0..1 scale."""
    unit = img / 255.0
    lum = grey(unit)
    r, g, b = unit.reshape(-1, 3).mean(axis=0)
    return {
        "mean_luminance": float(lum.mean()), "std_luminance": float(lum.std()), "mean_r": float(r),
        "mean_g": float(g), "mean_b": float(b), "laplacian_var": laplacian_variance(lum),
    }


def to_tensor(img: np.ndarray) -> np.ndarray:
    """0..255 to 0..1."""
    return as_bytes(img) / 255.0


def normalise(unit: np.ndarray) -> np.ndarray:
    """0..1 image to the encoder's channel-first, channel-normalised layout."""
    return ((unit - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1)


# --- camera-like effects ------------------------------------------------------------------------

# Parameter ranges of the effects and the probability of each, in application order.
CAMERA_RANGES = {
    "brightness": (0.7, 1.3), "contrast": (0.8, 1.3), "gamma": (0.9, 1.1), "saturation": (0.7, 1.2),
    "color_temperature": (0.9, 1.1), "hue_shift": (-10.0, 10.0), "sharpness": (0.5, 1.5),
    "blur_sigma": (0.0, 2.0), "noise_std": (0.0, 15 / 255), "rotation_deg": (-8.0, 8.0),
    "perspective": (-0.05, 0.05),
}
CAMERA_PROBABILITIES = {
    "brightness": 0.8, "contrast": 0.7, "gamma": 0.5, "saturation": 0.6, "color_temperature": 0.5,
    "hue_shift": 0.4, "sharpness": 0.5, "blur": 0.4, "noise": 0.3, "rotation": 0.6,
    "perspective": 0.2, "shadow": 0.3,
}
# Extra gate of the shadow effect, brightness of the shaded region.
SHADOW_GATE, SHADOW_LEVEL = 0.3, 180 / 255


def camera_config(ranges: dict | None = None, probabilities: dict | None = None, **extra) -> dict:
    """Effect settings: defaults overridden by name; ``fill`` is the background level (white 255)."""
    return {
        "range": {**CAMERA_RANGES, **(ranges or {})},
        "p": {**CAMERA_PROBABILITIES, **(probabilities or {})},
        "fill": extra.get("fill", 255.0), "shadow_gate": extra.get("shadow_gate", SHADOW_GATE),
    }


def blend(base, img: np.ndarray, factor: float) -> np.ndarray:
    """``base`` at factor 0, the image at 1, extrapolated beyond."""
    return base + (img - base) * factor


def exposure(img, factor):
    return blend(0.0, img, factor)


def contrast(img, factor):
    """Around the mean luminance, which is rounded half up (with a tolerance for rounding noise)."""
    return blend(np.floor(grey(img).mean() + 0.5 + 1e-6), img, factor)


def gamma_curve(img, gamma):
    return 255.0 * (img / 255.0) ** (1.0 / max(gamma, 1e-6))


def saturation(img, factor):
    return blend(grey(img)[:, :, None], img, factor)


def color_temperature(img, t):
    """Warm above 1 (less blue), cool below (less red); every gain is bounded."""
    # fixed values: gains and their limits
    if t > 1.0:
        gains = [min(t, 1.4), min(0.95 * t, 1.2), max(0.7 * t, 0.8)]
    else:
        gains = [max(0.8 * t, 0.7), max(0.9 * t, 0.8), min(1.2 * t, 1.3)]
    return img * np.array(gains)


def hue_shift(img, shift):
    """Rotate the hue by ``shift`` of 256 steps, keeping value and chroma."""
    top, low = img.max(axis=2), img.min(axis=2)
    chroma = top - low
    safe = np.where(chroma > 0, chroma, 1.0)
    r, g, b = np.moveaxis(img, 2, 0)
    sector = np.select(
        [chroma == 0, top == r, top == g], [0.0 * r, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4
    )
    turned = (sector + shift * 6 / 256) % 6
    # distance of each channel's own hue (0, 2, 4) around the circle gives its share of the chroma
    away = np.abs((turned[:, :, None] - np.array([0.0, 2.0, 4.0]) + 3) % 6 - 3)
    return low[:, :, None] + chroma[:, :, None] * np.clip(2 - away, 0, 1)


def sharpness(img, factor):
    return blend(smooth(img), img, factor)


def blur(img, sigma):
    return gaussian_blur(img, sigma) if sigma > 0.05 else img


def noise(img, std, rng):
    return img + 255.0 * rng.normal(0.0, std, img.shape) if std > 0 else img


def perspective(img, strength, fill):
    offset = int(img.shape[1] * strength)
    return trapezoid(img, offset, fill) if abs(offset) > 2 else img


def shadow(img, rng):
    """A darker rectangle in the upper left part of the image."""
    h, w = img.shape[:2]
    y, x = rng.integers(0, h // 3 + 1), rng.integers(0, w // 3 + 1)
    tall, wide = rng.integers(h // 4, h // 2 + 1), rng.integers(w // 4, w // 2 + 1)
    out = img.copy()
    out[y:y + tall, x:x + wide] *= SHADOW_LEVEL
    return out


def camera_like(img: np.ndarray, seed: int, cfg: dict) -> np.ndarray:
    """One augmented variant; each effect is applied with its own probability, in fixed order."""
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    span, fill = cfg["range"], cfg["fill"]
    draw = lambda name: rng.uniform(*span[name])
    steps = {
        "brightness": lambda i: exposure(i, draw("brightness")),
        "contrast": lambda i: contrast(i, draw("contrast")),
        "gamma": lambda i: gamma_curve(i, draw("gamma")),
        "saturation": lambda i: saturation(i, draw("saturation")),
        "color_temperature": lambda i: color_temperature(i, draw("color_temperature")),
        "hue_shift": lambda i: hue_shift(i, draw("hue_shift")),
        "sharpness": lambda i: sharpness(i, draw("sharpness")),
        "blur": lambda i: blur(i, draw("blur_sigma")),
        "noise": lambda i: noise(i, draw("noise_std"), rng),
        "rotation": lambda i: rotate(i, draw("rotation_deg"), fill),
        # perspective and shadow pass a second gate on top of their probability
        "perspective": lambda i: i if rng.random() > span["perspective"][1] else perspective(i, draw("perspective"), fill),
        "shadow": lambda i: i if rng.random() > cfg["shadow_gate"] else shadow(i, rng),
    }
    for name, step in steps.items():
        if rng.random() < cfg["p"][name]:
            img = as_bytes(step(img)).astype(np.float64)
    return img


def training_view(img: np.ndarray, seed: int, cfg: dict) -> np.ndarray:
    """Resized, jittered, normalised view; keys as in the training settings."""
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    img = resize(img, *cfg["size"])
    if cfg.get("rotation_deg", 0) > 0:
        img = rotate(img, rng.uniform(-cfg["rotation_deg"], cfg["rotation_deg"]), 0.0)
    jitter = [(f, cfg[n]) for n, f in (("brightness", exposure), ("contrast", contrast)) if cfg.get(n)]
    for i in rng.permutation(len(jitter)):
        effect, (low, high) = jitter[i]
        img = np.clip(effect(img, rng.uniform(low, high)), 0, 255)
    if rng.random() < cfg.get("blur_prob", 0.0):
        img = gaussian_blur(img, rng.uniform(0.1, 1.5), half=1)
    unit = to_tensor(img)
    if cfg.get("noise_std", 0) > 0:
        unit = np.clip(unit + rng.normal(0.0, cfg["noise_std"], unit.shape), 0.0, 1.0)
    return normalise(unit)
