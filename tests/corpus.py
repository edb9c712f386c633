"""A flow document of our own: a greenhouse whose sensors and gardeners report over two days; every value is made up here."""

HOUR = "2031-03-04T09:"


def tool_run(kind, actor, minute):
    return {"runType": kind, "actorKey": actor, "tool": {"name": actor}, "config": {"depth": 2.5}, "startedAt": f"{HOUR}{minute}:00Z", "completedAt": f"{HOUR}{minute}:30Z"}


def reading(name, sensor, degrees, minute, parents=None):
    step = {"step": "event", "as": name, "payload": {"degrees": degrees}, "observedAt": f"{HOUR}{minute}:00Z", "actorPath": ["house", "north", sensor], "channelPath": ["climate", "heat"], "valueKind": "reading", "provenance": {"rig": sensor}}
    return step | ({"parents": parents} if parents is not None else {})


def action(name, kind, parents, at):
    return {"step": "event", "as": name, "payload": {"did": kind}, "observedAt": at, "actorPath": ["house", "staff", "iris"], "channelPath": ["work", kind], "valueKind": kind, "parents": parents}


def core(object_):
    return {"kind": "claim", "schema": "claim-core-v0.1", "subject": {"bed": "north"}, "predicate": {"name": "needs"}, "object": {"what": object_}}


def document():
    note = {"server": "radio", "room": "#beds", "nick": "otto", "message": "soil is dry", "raw": "otto> soil is dry", "observedAt": f"{HOUR}02:00Z"}
    occurrence = lambda name, object_, source, **more: {"step": "claim", "as": name, "core": core(object_), "source": source, "run": "$read.id", "evidence": {"kind": "span"}, **more}
    steps = [
        {"step": "message", "as": "note", **note},
        {"step": "message", "as": "again", **note},
        reading("hot", "s1", 31.5, "03"),
        reading("hotter", "s2", 33, "04"),
        reading("same", "s1", 31.5, "05"),
        action("opened", "vent", ["$hot.event_id"], f"{HOUR}10:00Z"),
        action("watered", "water", ["$opened.event_id"], f"{HOUR}12:00Z"),
        action("next_day", "water", ["$hotter.event_id"], "2031-03-05T08:00:00Z"),
        {"step": "run", "as": "read", "run": tool_run("claim-extraction", "reader-7", "20"), "inputs": ["$note.event_id", "$hot.event_id"]},
        occurrence("thirsty", "water", "$note.event_id", confidence=0.6),
        occurrence("thirsty_too", "water", "$hotter.event_id", polarity="denied"),
        occurrence("airless", "air", "$hot.event_id"),
        {"step": "feature", "as": "heat", "core": {"kind": "feature", "schema": "feature-core-v0.1", "featureType": "heat", "value": 3}, "source": "$hot.event_id", "run": "$read.id", "evidence": {"kind": "whole"}, "confidence": 0.5},
        {"step": "cluster", "as": "needs", "relation": "near", "members": ["$thirsty.claim.id", "$airless.claim.id"], "method": {"name": "by-hand"}},
        {"step": "snapshot", "as": "hour", "shard": "/2031/03/04/09"},
        {"step": "run", "as": "dig", "run": tool_run("pattern-mining", "digger-1", "40"), "snapshots": ["$hour.cid"]},
        {"step": "sequence", "as": "cool", "snapshot": "$hour", "kinds": ["reading", "vent", "water"], "run": "$dig.id", "miner": "digger-1"},
        {"step": "itemset", "as": "twice", "snapshot": "$hour", "tokens": ["event.kind:reading", "actor:/house/north/s1"], "run": "$dig.id", "miner": "digger-1", "least": 2},
        {"step": "motif", "as": "reply", "snapshot": "$hour", "parent": "reading", "child": "vent", "run": "$dig.id", "miner": "digger-1"},
        {"step": "motif", "as": "nothing", "snapshot": "$hour", "parent": "water", "child": "vent", "run": "$dig.id", "miner": "digger-1"},
        {"step": "run", "as": "think", "run": tool_run("reasoning", "thinker-2", "50"), "inputs": ["$note.event_id"]},
        {"step": "run", "as": "rethink", "run": tool_run("reasoning-again", "thinker-2", "55"), "inputs": ["$note.event_id"]},
        {"step": "reasoning_input", "as": "given", "claim": "$thirsty.claim", "statement": "north needs water", "patterns": ["$cool.id", "$reply.id"]},
        {"step": "belief", "as": "first", "given": "$given", "run": "$think.id", "truth": {"frequency": 0.5, "confidence": 0.25}, "policy": "last"},
        {"step": "belief", "as": "second", "given": "$given", "run": "$rethink.id", "truth": {"frequency": 0.75, "confidence": 0.5}, "policy": "last"},
        {"step": "history", "as": "story", "claim": "$thirsty.claim.id", "outputs": ["$first", "$second"], "policy": "last"},
    ]
    checks = {
        "a repeat is refused": ["$again.accepted", False],
        "one payload, two events": ["$hot.payload_cid", "$same.payload_cid"],
        "a trace holds its events": [{"lookup": ["root", "$hot.event_id"]}, ["$hot.event_id", "$opened.event_id", "$watered.event_id"]],
        "a claim has two occurrences": [{"lookup": ["occurrences_by_claim", "$thirsty.claim.id"]}, ["$thirsty.id", "$thirsty_too.id"]],
        "evidence is parted": [["$given.positive", "$given.negative"], [["$thirsty.id"], ["$thirsty_too.id"]]],
        "a motif without support has no pattern": ["$nothing.id", None],
        "histories list outputs": [{"lookup": ["histories_by_output", "$second.id"]}, ["$story.id"]],
        "a dollar sign": ["$$x", "$$x"],
    }
    return {"kind": "greenhouse-flow", "schema": "flow-v1", "covers": ["events", "patterns"], "steps": steps, "checks": checks}
