"""Common properties of sound banks: what an identifier means in a version, and how its four bytes are read."""

from __future__ import annotations

import struct
from functools import cache

from .binary import FormatError

#: Name, kind and default, then the identifier from each version on; "-" ends it. "x4": four of them, numbered.
_AUDIO = """
bus_volume float 0: 0:4 112:5 150:4
output_bus_volume float 0: 0:23 118:24 150:13
output_bus_low_pass_filter float 0: 0:24 112:25 118:26 150:15
output_bus_high_pass_filter float 0: 112:24 118:25 150:14
voice_volume float 0: 0:0
voice_pitch float 0: 0:2 150:1
voice_low_pass_filter float 0: 0:3 150:2
voice_high_pass_filter float 0: 112:4 150:3
voice_volume_make_up_gain float 0: 88:33 118:6 150:5
game_defined_auxiliary_send_volume float 0: 0:22 118:23 150:12
game_defined_auxiliary_send_low_pass_filter float 0: 128:68 150:24
game_defined_auxiliary_send_high_pass_filter float 0: 128:69 150:25
user_defined_auxiliary_send_volume x4 float 0: 0:18 118:19 150:8
user_defined_auxiliary_send_low_pass_filter x4 float 0: 128:60 150:16
user_defined_auxiliary_send_high_pass_filter x4 float 0: 128:64 150:20
early_reflection_auxiliary_send_volume float 0: 135:72 150:26
positioning_center_percent float 0: 0:13 118:14 150:41
positioning_speaker_panning_x float 0: 0:11 118:12 150:35
positioning_speaker_panning_y float 0: 0:12 118:13 150:36
positioning_speaker_panning_z float 0: 140:73 150:37
positioning_listener_routing_speaker_panning_division_spatialization_mix float 100: 132:71 150:42
positioning_listener_routing_attenuation_identifier identifier 0: 132:70 150:85
hdr_threshold float 0: 88:26 118:27
hdr_ratio float 0: 88:27 118:28
hdr_release_time float 0: 88:28 118:29
hdr_window_tap_output_game_parameter_identifier identifier 0: 88:29 118:30 150:61
hdr_window_tap_output_game_parameter_minimum float 0: 88:30 118:31 150:62
hdr_window_tap_output_game_parameter_maximum float 0: 88:31 118:32 150:63
hdr_envelope_tracking_active_range float 12: 88:32 118:33 150:30
playback_initial_delay float 0: 88:25 112:59 150:34
playback_loop integer 0: 0:7 112:58 150:84
playback_speed float 1: 112:54 150:33
playback_priority_value float 0: 0:5 112:6 118:7 150:6
playback_priority_offset_at_maximum_distance float 0: 0:6 112:7 118:8 150:56
motion_volume_offset float 0: 0:8 118:9 128:-
motion_low_pass_filter float 0: 0:9 118:10 128:-
mixer_identifier identifier 0: 112:57 150:-
midi_note_tracking_root_note integer 60: 112:45 150:75
midi_event_play_on enumerated 0: 112:46 150:76
midi_transformation_transposition integer 0: 112:47 150:31
midi_transformation_velocity_offset integer 0: 112:48 150:32
midi_filter_key_range_minimum integer 0: 112:49 150:77
midi_filter_key_range_maximum integer 127: 112:50 150:78
midi_filter_velocity_range_minimum integer 0: 112:51 150:79
midi_filter_velocity_range_maximum integer 127: 112:52 150:80
midi_filter_channel integer 65535: 112:53 150:81
midi_clip_tempo_source enumerated 0: 112:55 150:82
midi_target_identifier identifier 0: 112:56 150:83
"""
_MODULATOR = """
scope enumerated 0: 112:0
stop_playback boolean 1: 112:1
depth float 100: 112:2
attack float 0: 112:3
frequency float 1: 112:4
waveform enumerated 0: 112:5
smoothing float 0: 112:6
pulse_width_modulation float 50: 112:7
initial_phase_offset float 0: 112:8
attack_time float 0.2: 112:9 150:10
attack_curve float 50: 112:10 150:11
decay_time float 0.2: 112:11 150:12
sustain_level float 100: 112:12 150:13
sustain_time float 0: 112:13 150:14
release_time float 0.5: 112:14 150:15
trigger_on enumerated 0: 112:15 150:16
duration float 1: 112:16 150:17
loop integer 1: 112:17 150:18
playback_rate float 1: 112:18 150:19
initial_delay float 0: 112:19 150:20
"""
_EVENT_ACTION = """
delay integer 0: 0:14 118:15 150:57
fade_time integer 0: 0:15 118:16 150:58
probability float 100: 0:16 118:17 150:59
"""
_DOMAINS = {"audio": _AUDIO, "modulator": _MODULATOR, "event_action": _EVENT_ACTION}
_FORMS = {"boolean": "I", "integer": "i", "float": "f", "enumerated": "I", "identifier": "I"}


@cache
def descriptors() -> tuple[dict, ...]:
    """(domain, value, since, until, name, kind, default) of every identifier; until is exclusive, None where it goes on."""
    out = []
    for domain, text in _DOMAINS.items():
        for line in text.strip().split("\n"):
            head, _, spans = line.partition(": ")
            name, *many, kind, default = head.split()
            steps = [(int(v), i) for v, i in (s.split(":") for s in spans.split())]
            for (since, first), (until, _) in zip(steps, [*steps[1:], (None, None)]):
                if first != "-":
                    for k in range(4 if many else 1):
                        out.append({"domain": domain, "value": int(first) + k, "since": since, "until": until, "name": f"{name}_{k}" if many else name, "kind": kind, "default": float(default)})
    return tuple(out)


@cache
def _by_id() -> dict[tuple[str, int], list[dict]]:
    out: dict[tuple[str, int], list[dict]] = {}
    for d in descriptors():
        out.setdefault((d["domain"], d["value"]), []).append(d)
    return out


def descriptor(version: int, domain: str, value: int) -> dict | None:
    """What an identifier means; None where a version has none, so that its raw bytes can be kept."""
    if domain not in _DOMAINS:
        raise FormatError(f"no domain {domain}")
    return next((d for d in _by_id().get((domain, value), ()) if d["since"] <= version and (d["until"] is None or version < d["until"])), None)


def read_value(kind: str, raw: bytes) -> bool | int | float:
    """The four bytes of a property as its kind says."""
    if kind not in _FORMS or len(raw) != 4:
        raise FormatError(f"{len(raw)} bytes of kind {kind}")
    value = struct.unpack("<" + _FORMS[kind], raw)[0]
    if kind == "boolean" and value > 1:
        raise FormatError(f"{value} is no truth value")
    return bool(value) if kind == "boolean" else value


def write_value(kind: str, value: bool | int | float) -> bytes:
    if kind not in _FORMS or isinstance(value, bool) != (kind == "boolean") or isinstance(value, float) != (kind == "float"):
        raise FormatError(f"{value!r} is not of kind {kind}")
    try:
        return struct.pack("<" + _FORMS[kind], value)
    except (struct.error, OverflowError) as error:
        raise FormatError(f"{value} is no {kind}") from error
