"""Prints digests of whole licence texts for ``license_digests``: python -m ratergrid.llm.make_license_digests FOLDER

FOLDER holds one file per licence, named by its identifier (Apache-2.0.txt). Of each text the whole counts, the text
after its title, with each of some common titles, and the terms up to an end mark, without what follows them.
"""

from __future__ import annotations

import sys
from pathlib import Path

from ratergrid.llm.licenses import canonical, digest
from ratergrid.session import build_session

#: Lines after which only advice on how to apply a licence follows. Fixed values.
END_MARKS = ["END OF TERMS AND CONDITIONS"]
TITLES = ["{id} License", "The {id} License", "The {id} License ({id})", "{id}"]


def variants(name: str, text: str) -> list[str]:
    """The forms of a licence text in which it is commonly found."""
    text = text.strip()
    title, _, rest = text.partition("\n\n")
    bodies = [text] + ([rest] if rest and len(title) < 100 else [])
    for body in list(bodies):
        for mark in END_MARKS:
            if mark in body:
                bodies += [body.partition(mark)[0], body.partition(mark)[0] + mark]
    short = name.split("-")[0]
    return bodies + [f"{form.format(id=i)}\n\n{rest}" for form in TITLES for i in {name, short} if rest]


def main(folder: str) -> None:
    rows = [(p.stem, v) for p in sorted(Path(folder).iterdir()) if p.is_file()
            for v in variants(p.stem, p.read_text(errors="replace"))]
    spark = build_session("local[2]", 2)
    table = spark.createDataFrame(rows, "id string, text string").select("id", digest(canonical("text")).alias("digest")).distinct()
    found: dict[str, list[str]] = {}
    for row in table.orderBy("id", "digest").collect():  # configuration: a few forms of each file
        found.setdefault(row["id"], []).append(row["digest"])
    for name, digests in found.items():
        print(f'    "{name}": """\n' + "\n".join(digests) + '\n""",')
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
