"""Where results go: names that follow from the inputs, text files, and standard output."""

from __future__ import annotations

import os
import re
import sys

from pyspark.sql import DataFrame

#: Ending of each kind of output; fixed values.
ENDINGS = {"index": ".index.tar", "zip": ".zip"}


def is_base(path: str) -> bool:
    """Whether an archive's name has no foundry."""
    return bool(re.fullmatch(r"[^.]*\.zip", os.path.basename(path)))


def default_name(inputs: list[str], kind: str, folder: str = ".", output: str | None = None, foundry: str | None = None, archive: str | None = None) -> str:
    """The path that a result has if none is given.

    index: the base archive's name (else the first's); of an update (``archive`` read) its name with ``.updated``. zip: the
    archive's name with the foundry that is made, or of a CoNLL-U file the same name. A given path of an index always
    ends in .tar."""
    if kind == "index":
        if output:
            return output if output.endswith(".tar") else f"{output}.tar"
        if archive:
            return os.path.join(folder, re.sub(r"(\.index)?\.tar$", "", os.path.basename(archive)) + ".updated" + ENDINGS["index"])
        base = next((p for p in inputs if is_base(p)), inputs[0])
        return os.path.join(folder, os.path.basename(base).removesuffix(".zip") + ENDINGS["index"])
    if output:
        return output
    if inputs[0].endswith(".conllu"):
        name = inputs[0].removesuffix(".conllu") + ".zip"
        return name if folder == "." else os.path.join(folder, os.path.basename(name))
    return os.path.join(folder, f"{os.path.basename(inputs[0]).removesuffix('.zip')}.{foundry}.zip")


def write_text(lines: DataFrame, path: str | None = None, overwrite: bool = False) -> None:
    """Write the only column of ``lines``, a text a row. No path: to standard output, partition by partition. A path that ends in
    .gz is compressed; what is there already is an error unless ``overwrite``."""
    if path is None:
        for row in lines.toLocalIterator():
            sys.stdout.write(row[0] + "\n")
        return
    writer = lines.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", "gzip") if path.endswith(".gz") else writer).text(path)
