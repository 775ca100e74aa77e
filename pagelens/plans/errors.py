"""Typed errors of the read plans."""

from __future__ import annotations


class AuditError(Exception):
    code = "SEO_ERROR"


def _error(name: str, code: str) -> type[AuditError]:
    return type(name, (AuditError,), {"code": code})


# fixed values -----------------------------------------------------------------------------------
NoSites = _error("NoSites", "SEO_NO_SITES")
NoRuns = _error("NoRuns", "SEO_NO_RUNS")
RunNotFound = _error("RunNotFound", "SEO_RUN_NOT_FOUND")
RunAlreadyDone = _error("RunAlreadyDone", "SEO_RUN_ALREADY_DONE")
RunFailed = _error("RunFailed", "SEO_RUN_FAILED")
StorageFailed = _error("StorageFailed", "SEO_STORAGE_FAILED")
SiteNotFound = _error("SiteNotFound", "SEO_SITE_NOT_FOUND")
NothingToShow = _error("NothingToShow", "SEO_NOTHING_TO_SHOW")
Unreadable = _error("Unreadable", "SEO_DB_UNREADABLE")
BadInput = _error("BadInput", "SEO_BAD_INPUT")
PageNotFound = _error("PageNotFound", "SEO_PAGE_NOT_FOUND")
PageSiteMismatch = _error("PageSiteMismatch", "SEO_PAGE_SITE_MISMATCH")
# end of fixed values ----------------------------------------------------------------------------
