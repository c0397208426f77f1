"""A worked declaration: parcels followed by what depots, customs and billing say about them.

Three shapes of event meet in one session: bookings (`kind`, fields at the top), scans (`scan.*`)
and charges (`charge.*`, amounts as numbers or texts).
"""

from __future__ import annotations

from keyfold.functions import collections as c
from keyfold.functions import values as v
from keyfold.operators.schema import Accept, Counter, GroupedMap, LastSeen, LatestBy, Retention, Schema, Stream, Transformer, WriteOnce


def _kind(*names: str):
    def test(r):
        out = v.equal(r["kind"], v.lit(names[0]))
        for n in names[1:]:
            out = v.either(out, v.equal(r["kind"], v.lit(n)))
        return out

    return test


SCHEMA = Schema(
    aggregate="parcel",
    version=1,
    id_type="parcel",
    primary_key="{parcel|scan.parcel|charge.parcel}",
    accept=Accept(
        require=("parcel|scan.parcel|charge.parcel",),
        reject_if_contains="TEST",
        event_types=("booked", "rebooked", "scanned", "charged"),
        event_type_path="kind",
        tenants=("north", "south"),
        tenant_path="network|scan.network|charge.network",
    ),
    fields={
        "booking": LatestBy(comparator=lambda r: r["revision"], when=_kind("booked", "rebooked")),
        "sender": WriteOnce(value=lambda r: r["sender"]),
        "courier": LastSeen(value=lambda r: r["scan.courier"], when=_kind("scanned")),
        "depots": GroupedMap(
            key=lambda r: r["scan.depot"],
            value=LatestBy(comparator=lambda r: v.parse_time(r["scan.at"], "rfc3339"), payload=lambda r: r["scan"]),
            when=_kind("scanned"),
        ),
        "charges": GroupedMap(
            key=lambda r: r["charge.invoice"],
            value=LatestBy(comparator=lambda r: v.parse_time(r["charge.day"], "epoch_seconds"), payload=lambda r: r["charge"]),
            when=_kind("charged"),
        ),
        "scans": Counter(when=_kind("scanned")),
    },
)


def _booked(part: str):
    return lambda s: s.value(f"booking.payload.{part}")


TRANSFORMER = Transformer(
    (
        Stream(
            name="parcels",
            topic="parcel-rows",
            gate=lambda s: v.Value(s["booking"].isNotNull(), "bool"),
            key=_booked("parcel"),
            retention=Retention(30, "due"),
            columns={
                "service": lambda s: v.coalesce(_booked("service")(s), v.lit("standard")),
                "due": _booked("due"),
                "sender": lambda s: s.value("sender"),
                "courier": lambda s: s.value("courier"),
                "scans": lambda s: s.value("scans"),
                "depots": lambda s: c.count(s["depots"]),
                "last_depot": lambda s: v.path(c.latest(s["depots"]), "depot"),
                "cost": lambda s: c.total(c.payloads(s["charges"]), lambda p: v.path(p, "amount")),
            },
        ),
        Stream(
            name="charges",
            topic="charge-rows",
            explode="charges",
            key=lambda s: v.concat(s.each("payload.invoice"), v.lit("/"), s.each("payload.parcel")),
            common={"sender": lambda s: s.value("sender")},
            each={
                "amount": lambda s: s.each("payload.amount"),
                "euros": lambda s: v.round_even(s.each("payload.amount")),
                "day": lambda s: v.bucket(s.each("payload.day"), v.lit(86_400)),
            },
        ),
    )
)
