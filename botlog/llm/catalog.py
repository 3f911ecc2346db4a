"""The registered queries of this package and the SQL of those that have one."""

from __future__ import annotations

from botlog.llm import bpe, common, dialogs, katz, langid, licenses, pages, pii, secrets, simhash, tiling, toxicity, vectors, whitening  # noqa: F401  importing a module registers its query


def all_queries():
    return dict(common.REGISTRY)


def all_oracles() -> dict[str, str]:
    return {"op6_license_scan": licenses.SQL, "op7_secret_scan": secrets.SQL}
