"""Column functions: everything that needs no grouping, by one import."""

from framewright.operators.batch import episode_state, failed_stage, integer_frames, numeric_order, resume_stage, scratch_bytes, version_tuple
from framewright.operators.geometry import dot, fuse_visibility, in_view, norm, project, quaternion_angle, ray_to_border, session_camera, slerp, unit, visible_landmarks
from framewright.operators.intervals import scheduled, two_sided_state
from framewright.operators.masks import blended, crossfade, over, overlap
from framewright.operators.poses import camera_points, composed, flipped, inverse, on_image, pose, product, rotation, times, transposed, unit_box
from framewright.operators.smoothing import finite, wrapped_distance
from framewright.operators.verification import segment_name, status_of
from framewright.operators.visibility import actuated, direct_visibility, hidden_links, is_file, out_of_memory, palm_markers, pixel_poses, scalar_first, side_name, unit_scale

__all__ = [
    "actuated", "blended", "camera_points", "composed", "crossfade", "direct_visibility", "dot", "episode_state", "failed_stage", "finite", "flipped", "fuse_visibility", "hidden_links", "in_view",
    "integer_frames", "inverse", "is_file", "norm", "numeric_order", "on_image", "out_of_memory", "over", "overlap", "palm_markers", "pixel_poses", "pose", "product", "project", "quaternion_angle",
    "ray_to_border", "resume_stage", "rotation", "scalar_first", "scheduled", "scratch_bytes", "segment_name", "session_camera", "side_name", "slerp", "status_of", "times", "transposed",
    "two_sided_state", "unit", "unit_box", "unit_scale", "version_tuple", "visible_landmarks", "wrapped_distance",
]
