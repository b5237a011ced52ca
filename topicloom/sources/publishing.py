"""The manifest of all datasets, and the pages that show them."""

from __future__ import annotations

import html
import json

from pyspark.sql import SparkSession

from topicloom.sources import files

ARTIFACT = "topics.json"
#: How a page's script names its dataset.
ENTRY = "const ENTRY="


def datasets(spark: SparkSession, root: str, file: str = ARTIFACT) -> list[str]:
    """Sorted names of the folders below root that hold the artifact."""
    return [name for name in files.folders(spark, root) if files.exists(spark, f"{root}/{name}/{file}")]


def manifest(spark: SparkSession, root: str, config: dict[str, dict] | None = None) -> list[dict]:
    """An entry for each dataset below root; what config ({id: {label, description, slug, excluded_years}}) doesn't say
    falls back on the id, an empty text, the id and no years."""
    found = []
    for name in datasets(spark, root):
        known, meta = (config or {}).get(name, {}), files.get_json(spark, f"{root}/{name}/{ARTIFACT}")["meta"]
        label = " ".join(w[:1].upper() + w[1:].lower() for w in name.replace("-", " ").replace("_", " ").split(" "))
        funders = meta["funders"]
        found.append({"id": name, "label": label, "description": "", "slug": name, "file": f"{name}/{ARTIFACT}", "n_docs": meta["n_docs"], "n_topics": meta["n_topics"], "funders": funders, "excluded_years": []} | known)
    return found


def write_manifest(spark: SparkSession, root: str, config: dict[str, dict] | None = None) -> list[dict]:
    found = manifest(spark, root, config)
    files.put_json(spark, f"{root}/manifest.json", found)
    return found


def dataset_page(template: str, entry: dict, folder_marker: str, folder: str) -> str:
    """A page for one dataset: in the template, folder_marker becomes folder, and the one line that begins with
    ``const ENTRY=`` states entry. Without the marker, or with another number of such lines, a ValueError."""
    lines = template.split("\n")
    places = [k for k, line in enumerate(lines) if line.lstrip().startswith(ENTRY)]
    if len(places) != 1 or folder_marker not in template:
        raise ValueError(f"the template has {len(places)} lines with {ENTRY!r} (one is needed) and {template.count(folder_marker)} of {folder_marker!r}")
    line = lines[places[0]]
    parts = ["\n".join(lines[: places[0]]), "\n".join(lines[places[0] + 1 :])]
    before, after = (part.replace(folder_marker, folder) for part in parts)
    own = line[: len(line) - len(line.lstrip())] + ENTRY + json.dumps(entry, ensure_ascii=False) + ";"
    return "\n".join(([before] if places[0] else []) + [own] + ([after] if places[0] + 1 < len(lines) else []))


def landing_page(title: str, entries: list[dict]) -> str:
    """A page that lists the datasets; labels and descriptions are escaped."""
    e = html.escape
    cards = "".join(f'<a href="{e(x["slug"])}.html"><h2>{e(x["label"])}</h2><p>{e(x["description"] or "")}</p><p>{x["n_docs"]:,} documents, {x["n_topics"]} topics</p></a>\n' for x in entries)
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><main><h1>{e(title)}</h1>\n{cards}</main></body></html>\n'


def publish(spark: SparkSession, root: str, template: str, out: str, title: str, folder_marker: str, folder: str, obsolete: tuple[str, ...] = ()) -> list[str]:
    """Puts the datasets of ``root``/manifest.json to ``out``: artifacts, a page each, the manifest and a landing page.
    Returns the pages' names; without a manifest or with an empty one, an error, before anything is written."""
    if not files.exists(spark, f"{root}/manifest.json"):
        raise FileNotFoundError(f"{root}/manifest.json")
    entries = files.get_json(spark, f"{root}/manifest.json")
    if not entries:
        raise ValueError("the manifest is empty")
    for name in obsolete:
        files.remove(spark, f"{out}/{name}")
    pages = []
    for x in entries:
        shown = {"id": x["id"], "label": x["label"], "file": f"datasets/{x['id']}.json", "excluded_years": x["excluded_years"]}
        files.copy(spark, f"{root}/{x['file']}", f"{out}/datasets/{x['id']}.json")
        files.put_text(spark, f"{out}/{x['slug']}.html", dataset_page(template, shown, folder_marker, folder))
        pages.append(f"{x['slug']}.html")
    files.put_json(spark, f"{out}/manifest.json", entries)
    files.put_text(spark, f"{out}/index.html", landing_page(title, entries))
    return ["index.html", *pages]
