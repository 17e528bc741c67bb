"""Fixed vocabularies and the rules over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: ids, name prefixes and terms that must match existing label files ---
CARDIO = ["run", "treadmill_walk", "treadmill_unspecified", "incline_walk", "elliptical", "free_walk", "stairs_up",
          "stairs_down", "interval_walk_run"]
NON_MOTION = ["sitting", "standing", "speaking", "chewing", "drinking", "gaming", "head_down", "head_up", "head_left",
              "head_right", "head_side", "head_turn", "other_non_motion"]
WEAR_IDS = ["removed_wear", "asymmetric_wear"]
UNKNOWN_MOTION = ["unknown_motion", "other_motion"]
WEAR_PREFIXES = ["不对称佩戴", "佩戴取下"]
WEAR_TERM = "掉落"
EXERCISE_PREFIXES = ["开合跳", "弓步蹲", "深蹲", "卷腹", "俯卧撑", "平板支撑", "跑步机"]
AMBIGUOUS_PREFIXES = ["自由行走", "慢走", "快走", "走路", "爬楼", "下楼", "坐下起立", "站起"]
NON_EXERCISE_PREFIXES = ["坐姿", "站立", "说话", "咀嚼", "喝水", "低头", "偏头", "弯腰取物"]
GOLD_SOURCES = ["operator_event", "video_review", "manual_timeline"]
TIERS = ["gold", "legacy_reviewed", "session_weak", "rejected"]
WEAR_STATES = ["valid", "removed", "asymmetric", "invalid"]
PHASES = ["active", "rest", "transition", "artifact"]
MOTION_STATES = ["motion", "non_motion"]
TRUSTED_REFERENCES = ["video_review", "trunk_imu", "motion_capture"]
SHORT_RECORDING_MAX_S = 180.0
# --- end of fixed values ---


def any_prefix(text: Column, prefixes: list[str]) -> Column:
    rule = F.lit(False)
    for p in prefixes:
        rule = rule | text.startswith(p)
    return rule


def state_by_prefix(name: Column) -> Column:
    """Binary-fitness state of a raw activity name; the first matching rule wins."""
    return (F.when(any_prefix(name, WEAR_PREFIXES) | name.contains(WEAR_TERM), "wear_artifact")
            .when(any_prefix(name, EXERCISE_PREFIXES), "exercise")
            .when(any_prefix(name, AMBIGUOUS_PREFIXES), "ambiguous")
            .when(any_prefix(name, NON_EXERCISE_PREFIXES), "non_exercise")
            .otherwise("unlabelled"))


def activity_family(activity: Column) -> Column:
    return (F.when(activity.isin(CARDIO), "cardio")
            .when(activity.isin(NON_MOTION + WEAR_IDS + UNKNOWN_MOTION), "other").otherwise("strength"))


def posture_deviations(roll: Column, pitch: Column, yaw: Column, yaw_reliable: Column, limit: float = 15.0) -> Column:
    """Deviation names in the order pitch, roll, yaw."""
    def side(v, low, high):
        return F.when(v <= -limit, low).when(v >= limit, high)

    return F.array_compact(F.array(side(pitch, "head_down", "head_up"), side(roll, "head_tilt_left", "head_tilt_right"),
                                   F.when(yaw_reliable, side(yaw, "head_turn_left", "head_turn_right"))))


def posture_state(deviations: Column) -> Column:
    return F.when(F.size(deviations) > 0, "poor").otherwise("normal")


def posture_by_name(stem: Column) -> Column:
    """Five posture classes from a file stem (fixed terms), or NULL."""
    return (F.when(stem.contains("挂脖子") | stem.contains("站起") | stem.contains("有头动"), None)
            .when(stem.contains("偏头"), "head_tilt").when(stem.contains("低头"), "head_down")
            .when(stem.contains("抬头"), "head_up").when(stem.contains("左看") | stem.contains("右看"), "head_turn")
            .when(stem.rlike(r"-坐姿(?:\d+)?$"), "normal"))
