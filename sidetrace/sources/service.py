"""Complete snapshots from a feature service, proven by its own counts and ids. Control plane: it runs on the driver.

The service is any callable (url, parameters, post) -> dict, so that tests need no network.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

Fetch = Callable[[str, dict, bool], dict]
MAX_BATCH, KEYED_BATCH = 2000, 500


class SourceError(RuntimeError):
    """The source is incomplete, changed while it was read, or answered with an error."""


def http(url: str, parameters: dict, post: bool = False, timeout: float = 120) -> dict:
    query = urllib.parse.urlencode(parameters)
    request = urllib.request.Request(url if post else f"{url}?{query}", data=query.encode() if post else None)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def _ask(fetch: Fetch, url: str, parameters: dict, post: bool = False) -> dict:
    answer = fetch(url, {**parameters, "f": parameters.get("f", "json")}, post)
    if not isinstance(answer, dict) or "error" in answer:
        raise SourceError(f"the service answered with an error: {str(answer)[:200]}")
    return answer


def id_field(metadata: dict) -> str:
    """The declared object-id field, else the one field of the object-id type."""
    declared = metadata.get("objectIdField")
    typed = [f.get("name") for f in metadata.get("fields") or [] if isinstance(f, dict) and f.get("type") == "esriFieldTypeOID"]
    found = declared if isinstance(declared, str) and declared else typed[0] if len(typed) == 1 else None
    if not found:
        raise SourceError("the layer declares no object-id field")
    return found


def property_of(feature: dict, name: str) -> str:
    """A property whatever the case of its name."""
    found = [v for k, v in (feature.get("properties") or {}).items() if k.lower() == name.lower()]
    if len(found) != 1 or found[0] is None:
        raise SourceError(f"a feature has no single {name}")
    return str(found[0])


def batches(ids: list[str], size: int) -> Iterator[list[str]]:
    for i in range(0, len(ids), size):
        yield ids[i : i + size]


def _state(fetch: Fetch, layer: str) -> dict:
    meta = _ask(fetch, layer, {})
    count = _ask(fetch, f"{layer}/query", {"where": "1=1", "returnCountOnly": "true"}).get("count")
    ids = _ask(fetch, f"{layer}/query", {"where": "1=1", "returnIdsOnly": "true"}).get("objectIds")
    if not isinstance(count, int) or isinstance(count, bool) or count <= 0 or not isinstance(ids, list):
        raise SourceError("the service gives no usable count and ids")
    edited = (meta.get("editingInfo") or {}).get("lastEditDate")
    if not isinstance(edited, int) or isinstance(edited, bool) or edited < 0:
        raise SourceError("the service gives no edit time")
    texts = sorted(map(str, ids))
    if len(set(texts)) != len(texts) or len(texts) != count:
        raise SourceError(f"{count} rows are advertised and {len(set(texts))} ids")
    return {"field": id_field(meta), "count": count, "ids": texts, "edited": edited, "version": meta.get("currentVersion"), "limit": meta.get("maxRecordCount", MAX_BATCH)}


def snapshot(layer: str, output: str, fetch: Fetch = http) -> dict:
    """Writes all features of a layer as GeoJSON in the text order of their ids, if the layer is the same before and after.

    Each batch must bring exactly the ids asked for. The output appears whole or not at all.
    """
    before = _state(fetch, layer)
    found: dict[str, dict] = {}
    for part in batches(before["ids"], min(max(int(before["limit"]), 1), MAX_BATCH)):
        page = _ask(fetch, f"{layer}/query", {"objectIds": ",".join(part), "outFields": "*", "returnGeometry": "true", "outSR": 4326, "f": "geojson"}, True).get("features")
        if not isinstance(page, list):
            raise SourceError("a page has no features")
        got = [property_of(f, before["field"]) for f in page]
        if len(set(got)) != len(got) or set(got) != set(part):
            raise SourceError(f"a page lacks {sorted(set(part) - set(got))[:10]}, has {sorted(set(got) - set(part))[:10]} too many, or repeats")
        found.update(zip(got, page, strict=True))
    if _state(fetch, layer) != before:
        raise SourceError("the source changed while it was read")
    with open(f"{output}.part", "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": [found[i] for i in before["ids"]]}, f, separators=(",", ":"))
    os.replace(f"{output}.part", output)
    return {"record_count": before["count"], "object_id_field": before["field"], "service_last_edit_ms": before["edited"], "service_version": before["version"]}


def keyed_subset(layer: str, field: str, keys: list[str], fetch: Fetch = http) -> list[dict]:
    """The features whose field is one of the keys, in batches, each feature once and none else."""
    wanted, found = sorted(set(keys)), {}
    for part in batches(wanted, KEYED_BATCH):
        page = _ask(fetch, f"{layer}/query", {"where": f"{field} IN ({','.join(part)})", "outFields": "*", "f": "geojson"}, True).get("features")
        for feature in page or []:
            key = property_of(feature, field)
            if key not in part:
                raise SourceError(f"{key} wasn't asked for")
            found.setdefault(key, []).append(feature)
    return [f for k in wanted for f in found.get(k, [])]


def keyed_proof(layer: str, field: str, keys: list[str], features: list[dict], fetch: Fetch = http) -> None:
    """Raises unless the features are just those whose ids the service lists for the keys, each once."""
    name, wanted = id_field(_ask(fetch, layer, {})), set()
    for part in batches(sorted(set(keys)), KEYED_BATCH):
        found = _ask(fetch, f"{layer}/query", {"where": f"{field} IN ({','.join(part)})", "returnIdsOnly": "true"}, True).get("objectIds")
        wanted |= set(map(str, found or []))
    got = [property_of(f, name) for f in features]
    if len(set(got)) != len(got) or set(got) != wanted:
        raise SourceError(f"ids are missing ({sorted(wanted - set(got))[:10]}), too many ({sorted(set(got) - wanted)[:10]}) or repeated")


#: What is kept of a layer's description, by our names.
REMOTE_KEYS = {"id": "id", "name": "name", "type": "type", "geometry_type": "geometryType", "object_id_field": "objectIdField", "max_record_count": "maxRecordCount", "current_version": "currentVersion", "last_edit_ms": "lastEditDate", "schema_last_edit_ms": "schemaLastEditDate"}


def remote_metadata(layer: str, fetch: Fetch = http) -> dict:
    """What a layer says of itself, nine values, to be compared before and after a read."""
    meta = _ask(fetch, layer, {})
    flat = {**meta, **(meta.get("editingInfo") or {})}
    return {ours: flat.get(theirs) for ours, theirs in REMOTE_KEYS.items()}


def sample(layer: str, output: str, n: int = 100, large: bool = False, fetch: Fetch = http) -> int:
    """Writes the first n features of a layer; more than 100 have to be asked for."""
    if n <= 0 or (n > 100 and not large):
        raise SourceError("a sample has 1 to 100 features unless a large one is asked for")
    page = _ask(fetch, f"{layer}/query", {"where": "1=1", "outFields": "*", "returnGeometry": "true", "outSR": 4326, "resultRecordCount": n, "f": "geojson"}).get("features") or []
    with open(f"{output}.part", "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": page[:n]}, f, separators=(",", ":"))
    os.replace(f"{output}.part", output)
    return len(page[:n])


def download(url: str, output: str, open_url: Callable = urllib.request.urlopen) -> int:
    """Streams a file to disk and checks its announced size; it appears whole or not at all."""
    size = 0
    with open_url(url) as answer, open(f"{output}.part", "wb") as f:
        announced = answer.headers.get("Content-Length")
        while chunk := answer.read(1 << 20):
            f.write(chunk)
            size += len(chunk)
    if not size or (announced is not None and int(announced) != size):
        os.remove(f"{output}.part")
        raise SourceError(f"{size} bytes came, {announced} were announced")
    os.replace(f"{output}.part", output)
    return size


def single_folder(archive: str, suffix: str = ".gdb") -> str:
    """The one folder of a suffix in a ZIP file; names that leave the archive's root are refused."""
    with zipfile.ZipFile(archive) as z:
        names = z.namelist()
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise SourceError("the archive has unsafe names")
    found = {"/".join(parts[: i + 1]) for parts in (n.split("/") for n in names) for i, p in enumerate(parts) if p.lower().endswith(suffix)}
    if len(found) != 1:
        raise SourceError(f"the archive has {len(found)} folders of {suffix}")
    return found.pop()
