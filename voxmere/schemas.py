"""Fixed schemas (DDL) of the engine's tables."""

VOXEL = "volume_id string, z int, y int, x int, v double"
BLOCK = "volume_id string, bz int, by int, bx int, c int, offset array<int>, shape array<int>, dtype string, data binary"
VOLUME = "volume_id string, brain string, channel string, ch_type string, zdim int, ydim int, xdim int, scale_x double, scale_y double, scale_z double, xtile int, ytile int, lightsheets int, horizontal_foci int, tiling_overlap double"
PLANE_FILE = "volume_id string, ch string, ls int, z int, y_tile int, x_tile int, path string, length bigint"
POINT = "brain string, point_id bigint, z double, y double, x double"
ANNOTATION = "z int, y int, x int, id bigint"
STRUCTURE = "id bigint, name string, acronym string, parent_structure_id bigint, parent_name string, parent_acronym string, voxels_in_structure bigint"
CLOSURE = "ancestor_id bigint, descendant_id bigint, depth int"
REGION_COUNT = "brain string, id bigint, cell_count bigint"
PATCH = "volume_id string, patch_id int, z0 int, y0 int, x0 int, pz int, py int, px int"
COMPONENT = "volume_id string, label bigint, z int, y int, x int, v double"
CELL_MEASURE = "volume_id string, z int, y int, x int, val bigint, max_perimeter double, sphericity double, z_depth int, no_voxels bigint, intensity double"
MATCH = "dataset string, cutoff double, truth_idx bigint, pred_idx bigint, dist double"
MATCH_STATS = "dataset string, cutoff double, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double"
CONTOUR = "volume_id string, z int, contour_id bigint, pts array<struct<y:double,x:double>>"
TRANSFORM = "chain_id string, ord int, kind string, matrix array<double>, grid struct<origin:array<double>,spacing:array<double>,size:array<int>>, coef binary"
LEARNING_LOG = "phase string, iter bigint, metric string, num double, den double"
PARAM = "expt string, key string, value string"
