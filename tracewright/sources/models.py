"""A library of leakage models: one Python file each in a folder that the driver reads.

Executors never read the folder; a compiled model travels to them with the query that uses it.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from tracewright.operators.cpa import compile_model


def file_name(name: str) -> str:
    """The name under which a model is stored: outer blanks go, and every character other than ASCII
    letters, digits, ``-`` and ``_`` becomes ``_``. A blank name is an error."""
    stem = re.sub(r"[^A-Za-z0-9_-]", "_", name.strip())
    if not stem:
        raise ValueError("a model needs a name")
    return f"{stem}.py"


def list_models(folder: str) -> list[str]:
    """Names of the stored models in order; none where there is no folder yet."""
    return sorted(p.stem for p in Path(folder).glob("*.py") if p.is_file())


def save_model(folder: str, name: str, source: str) -> str:
    """Stores a model's text as it is, in place of one of the same name, and returns the stored name.
    The text need not compile yet. Readers see the old text or the new one, never a part."""
    path = Path(folder, file_name(name))
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.stem}-{uuid.uuid4().hex}.part")
    part.write_text(source, "utf-8")
    os.replace(part, path)
    return path.stem


def model_source(folder: str, name: str) -> str:
    """The text of a stored model; a missing one is a ``FileNotFoundError``."""
    return Path(folder, file_name(name)).read_text("utf-8")


def load_model(folder: str, name: str) -> Callable:
    """A stored model, compiled."""
    return compile_model(model_source(folder, name))


def delete_model(folder: str, name: str) -> bool:
    """Removes a stored model; says whether there was one."""
    path = Path(folder, file_name(name))
    found = path.is_file()
    path.unlink(missing_ok=True)
    return found
