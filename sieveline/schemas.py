"""Schemas of the tables that pass between stages (Spark DDL)."""

CANDIDATES = "instance_id string, repo_short string, fix_commit string, base_commit string, date string, subject string, src_files array<string>, test_files array<string>"
ENRICHED = CANDIDATES + ", created_at string, pr_number bigint, pr_title string, pr_body string, issue_number bigint, issue_title string, issue_body string"
DIFFS = ENRICHED + ", patch string, test_patch string"
VERIFIED = DIFFS + ", verify struct<f2p_fail: boolean, p2p_pass: boolean, log: string>, verified boolean"
TASKS = "instance_id string, repo string, base_commit string, fix_commit string, problem_statement string, hints_text string, patch string, test_patch string, created_at string, fix_date string, pr_number bigint, test_files array<string>, n_src_files bigint, n_patch_lines bigint, n_test_files bigint"
RELEASES = "pkg string, ver string, upload_time string, ordinal bigint"
NODES = "instance_id string, id string, name string, text string, ord bigint"
EDGES = "instance_id string, source string, target string, type string, key bigint, ord bigint"
NODE_EMBEDDINGS = "instance_id string, id string, embedding array<float>"
SNAPSHOT_MEMBERS = "instance_id string, path string"
SFT = "instance_id string, repo string, user string, assistant string, test_files array<string>, test_patch string, split string"
GENERATIONS = SFT + ", gen string"
CHECKED = "instance_id string, repo string, apply_ok boolean, passed boolean, why string, test_tail string"
RESULTS = "instance_id string, steps bigint, seconds double, has_patch boolean, diff string, tool_hist map<string,bigint>, passed boolean, tail string, error string, model string, graph boolean, oracle boolean"
LOC_RANKS = "instance_id string, repo string, n_targets bigint, flat_rank bigint, graph_rank bigint"
OVERLAP = "ours string, external string, identical_edit_lines boolean"
GRAPH_FILE = "directed boolean, multigraph boolean, nodes array<struct<id: string, name: string, text: string>>, edges array<struct<source: string, target: string, type: string, key: bigint>>"
