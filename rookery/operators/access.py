"""Scopes, PKCE and the token lifecycle as a replay of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_TTL, ACCESS_TTL, REFRESH_TTL = 60.0, 3600.0, 30 * 86400.0
# Tool and the scope it needs.
TOOL_SCOPES = [("list_documents", "docs:read"), ("search", "docs:read"), ("ask", "docs:ask"), ("triage", "incidents:triage")]


def tool_scopes(spark) -> DataFrame:
    return spark.createDataFrame(TOOL_SCOPES, "tool string, scope string")


def scope_checks(calls: DataFrame, tool: str = "tool", scopes: str = "scopes") -> DataFrame:
    """calls with scope, allowed and missing (the scope that lacks); unknown tools are not allowed."""
    joined = calls.join(F.broadcast(tool_scopes(calls.sparkSession).withColumnRenamed("tool", "__tool")), F.col(tool) == F.col("__tool"), "left").drop("__tool")
    allowed = F.coalesce(F.array_contains(scopes, F.col("scope")), F.lit(False))
    return joined.withColumn("allowed", allowed).withColumn("missing", F.when(~allowed, F.col("scope")))


def allowed_tools(scopes: Column) -> Column:
    """Names of the tools that scopes open."""
    return F.array_compact(F.array(*[F.when(F.array_contains(scopes, s), t) for t, s in TOOL_SCOPES]))


def pkce_challenge(verifier: Column) -> Column:
    """base64url(sha256(verifier)) without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(verifier, 256))), "+/", "-_"), F.lit("="))


def pkce_valid(verifier: Column, challenge: Column, method: Column) -> Column:
    """S256 only."""
    return F.coalesce((method == "S256") & (pkce_challenge(verifier) == challenge), F.lit(False))


class TokenState:
    """What one client holds; apply() gives the outcome of an event."""

    def __init__(self):
        self.codes: dict[str, tuple[float, list[str]]] = {}
        self.access: dict[str, tuple[float, list[str]]] = {}
        self.refresh: dict[str, tuple[float, list[str]]] = {}

    def _grant(self, now: float, access: str, refresh: str, scopes: list[str]) -> None:
        self.access[access] = (now + ACCESS_TTL, scopes)
        self.refresh[refresh] = (now + REFRESH_TTL, scopes)

    def apply(self, now: float, event: str, token: str, scopes: list[str], access: str, refresh: str) -> str:
        if event == "authorize":
            self.codes[token] = (now + CODE_TTL, scopes)
            return "issued" if scopes else "invalid_scope"
        if event == "exchange":
            code = self.codes.pop(token, None)
            if code is None:
                return "code_replay"
            if code[0] < now:
                return "code_expired"
            self._grant(now, access, refresh, code[1])
            return "tokens"
        if event == "refresh":
            held = self.refresh.pop(token, None)
            if held is None or held[0] < now:
                return "invalid_refresh"
            self._grant(now, access, refresh, [s for s in scopes if s in held[1]] or held[1])
            return "rotated"
        if event == "use":
            held = self.access.get(token)
            if held is None or held[0] < now:
                self.access.pop(token, None)
                return "denied"
            return "ok"
        if event == "revoke":
            if self.refresh.pop(token, None) is not None:
                self.access.clear()
                return "revoked_all"
            return "revoked" if self.access.pop(token, None) is not None else "unknown"
        return "unknown_event"


EVENT_FIELDS = ["ts", "seq", "event", "token", "scopes", "access", "refresh"]


def token_replay(events: DataFrame, client: str = "client") -> DataFrame:
    """(client, ts, seq, event, outcome): each client's events in order (ts, seq).

    Codes work once, within CODE_TTL and for their client; refresh tokens rotate; scopes only
    narrow; revoking a refresh token ends all the client's access tokens. Events are sorted by the
    shuffle and streamed per client, so a client's history isn't held in memory at once.
    """
    kind = dict(events.dtypes)[client]
    ordered = events.select(client, *EVENT_FIELDS).repartition(client).sortWithinPartitions(client, "ts", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, TokenState()
        for pdf in batches:
            outcomes = []
            for c, ts, _, event, token, scopes, access, refresh in pdf.itertuples(index=False):
                if c != who:
                    who, state = c, TokenState()
                outcomes.append(state.apply(ts, event, token, list(scopes) if scopes is not None else [], access, refresh))
            yield pd.DataFrame({client: pdf[client], "ts": pdf["ts"], "seq": pdf["seq"], "event": pdf["event"], "outcome": outcomes})

    return ordered.mapInPandas(run, f"`{client}` {kind}, ts double, seq long, event string, outcome string")
