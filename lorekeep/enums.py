"""Labels, their orders and the tunables' defaults. They decide results and are part of the data model."""

SOURCE_TYPES = ("CODE", "ISSUE", "QA", "PLAYBOOK")
AUTHORITIES = ("DRAFT", "REVIEWED", "AUTHORITATIVE", "DEPRECATED")
FRESHNESS = ("FRESH", "STALE", "EXPIRED", "UNKNOWN")
PROVENANCE_KINDS = ("COMMIT", "ISSUE_URL", "DOC_ID", "MSG_ID", "MAIL_ID", "FILE")
RELATIONS = ("ISSUE_CODE", "QA_CODE", "SUPERSEDES")
TAINTS = ("CLEAN", "INTERNAL", "SENSITIVE")
DECISIONS = ("AUTO", "HUMAN_CONFIRM", "DENY")

FRESH_SCORE = {"FRESH": 1.0, "STALE": 0.3, "EXPIRED": 0.0, "UNKNOWN": 0.3}
AUTHORITY_SCORE = {"AUTHORITATIVE": 1.0, "REVIEWED": 0.7, "DRAFT": 0.2, "DEPRECATED": 0.0}
FRESH_DEFAULT, AUTHORITY_DEFAULT = 0.3, 0.2

TRANSITIONS = {
    "DRAFT": ("REVIEWED", "DEPRECATED"),
    "REVIEWED": ("AUTHORITATIVE", "DEPRECATED", "DRAFT"),
    "AUTHORITATIVE": ("REVIEWED", "DEPRECATED"),
    "DEPRECATED": ("REVIEWED",),
}

COMMITMENT_MARKERS = ("承诺", "保证", "决定", "拍板", "对外", "口径", "上线时间", "deadline", "commit to", "guarantee", "we will", "官方")
ANSWER_PREFIX = "助理代答(待本人复核)"

SETTINGS = {
    "w_fresh": 0.3, "w_auth": 0.3, "w_rel": 0.4,
    "abstain_rel_min": 0.35, "abstain_lex_min": 0.15, "conf_floor": 0.45, "coverage_min": 0.6, "top_n": 5,
}


def settings(overrides: dict | None = None) -> dict:
    """The tunables with overrides; a value that is no number of the default's kind leaves the default."""
    out = dict(SETTINGS)
    for k, v in (overrides or {}).items():
        if k in out:
            try:
                out[k] = type(out[k])(v)
            except (TypeError, ValueError):
                pass
    return out
