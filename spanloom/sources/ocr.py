"""Readers of page images: which ones there are, and which one a process uses.

A reader is a function from image bytes to text, made by a loader that raises ImportError where its library is missing. A process makes
its reader once. The environment variable SPANLOOM_OCR names one; without it, or with `auto`, the first that
loads is taken, heavy ones (large models) excepted: those run only by name.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

ImageReader = Callable[[bytes], str]
VARIABLE, AUTO = "SPANLOOM_OCR", "auto"

_loaders: dict[str, tuple[Callable[[], ImageReader], bool]] = {}
_made: dict[str, ImageReader] = {}


def register(name: str, loader: Callable[[], ImageReader], heavy: bool = False) -> None:
    """Offer a reader under a name; a name that is taken is replaced."""
    _loaders[name] = loader, heavy
    _made.pop(name, None)


def reset() -> None:
    """Forget the readers that were made."""
    _made.clear()


def _reader(name: str) -> ImageReader:
    if name not in _made:
        _made[name] = _loaders[name][0]()
    return _made[name]


def reader(name: str | None = None) -> ImageReader:
    """The reader of that name, or the process's choice. RuntimeError where there is none."""
    name = name or os.environ.get(VARIABLE, AUTO)
    if name != AUTO and name not in _loaders:
        raise RuntimeError(f"no reader of images is called {name!r}; known are {', '.join(sorted(_loaders))}")
    for each in [name] if name != AUTO else [n for n, (_, heavy) in _loaders.items() if not heavy]:
        try:
            return _reader(each)
        except ImportError:
            continue
    raise RuntimeError("no reader of images is installed")


def available(name: str | None = None) -> bool:
    try:
        reader(name)
    except RuntimeError:
        return False
    return True


def _tesseract() -> ImageReader:
    import pytesseract
    from PIL import Image

    return lambda data: pytesseract.image_to_string(Image.open(io.BytesIO(data)))


def _rapidocr() -> ImageReader:
    from rapidocr_onnxruntime import RapidOCR

    engine = RapidOCR()

    def read(data: bytes) -> str:
        found, _ = engine(data)
        return "\n".join(line[1] for line in found or ())

    return read


register("tesseract", _tesseract)
register("rapidocr", _rapidocr)
