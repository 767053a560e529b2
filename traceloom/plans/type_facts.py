"""Fixed values of engineering types: which cannot be summed, and which marks stand for a missing value."""

from __future__ import annotations

# Types whose values cannot be summed or averaged.
CATEGORICAL = [
    "account-numeric-identifier",
    "address",
    "ane-event-name",
    "app-period",
    "ar-event-name",
    "arg-signature",
    "backtrace",
    "boolean",
    "capability",
    "category",
    "cfrunloop-result",
    "combine-category",
    "combine-datatap-name",
    "combine-subscription-name",
    "compositor-event-name",
    "config-id",
    "connection-filter",
    "connection-meta",
    "connection-name",
    "connection-route",
    "connection-uuid",
    "connection-uuid64",
    "console-text",
    "core",
    "core-state",
    "coreml-model-name",
    "cpu-arch-name",
    "data",
    "device-session",
    "diskio-operation",
    "dispatch-queue",
    "dispatch-work-state",
    "display-compositor-event-name",
    "display-compositor-name",
    "display-event-name",
    "display-name",
    "displayed-surface-io-surface",
    "displayed-surface-swap",
    "domain-name",
    "eight-byte-array",
    "eight-byte-array-le",
    "energy-impact",
    "errno",
    "errno-value",
    "event",
    "event-concept",
    "event-type",
    "fd",
    "file-path",
    "format-string",
    "formatted-label",
    "glass-state",
    "gpu-channel-name",
    "gpu-counter-name",
    "gpu-driver-channel",
    "gpu-driver-event",
    "gpu-driver-event-name",
    "gpu-driver-event-source",
    "gpu-driver-gpu-sub",
    "gpu-driver-name",
    "gpu-driver-segment",
    "gpu-driver-submission",
    "gpu-driver-surface",
    "gpu-engine-state",
    "gpu-event-name",
    "gpu-frame-number",
    "gpu-hardware-engine",
    "gpu-hardware-event",
    "gpu-hardware-event-src",
    "gpu-hardware-trace",
    "gpu-memory-event-name",
    "gpu-performance-state",
    "gpu-power-state",
    "gpu-state",
    "graphics-driver-name",
    "graphics-driver-statistic",
    "hang-type",
    "hitch-phase",
    "instrument-instance",
    "instrument-type",
    "kdebug-arg",
    "kdebug-class",
    "kdebug-code",
    "kdebug-func",
    "kdebug-plist-subtrack-name",
    "kdebug-signpost-variant",
    "kdebug-string",
    "kdebug-subclass",
    "key",
    "key-value-array",
    "kperf-bt",
    "location-event",
    "medium-length-string",
    "metadata",
    "metal-command-buffer-id",
    "metal-compiler-request",
    "metal-device-id",
    "metal-device-name",
    "metal-encoder-id",
    "metal-event",
    "metal-event-name",
    "metal-nesting-level",
    "metal-object-label",
    "metal-workload-priority",
    "mime-content-type",
    "mps-event-name",
    "narrative",
    "narrative-certainty",
    "narrative-significance",
    "narrative-text",
    "network-interface",
    "network-protocol",
    "node",
    "os-log-metadata",
    "os-signpost-identifier",
    "packed-identifier",
    "pid",
    "pmc-events",
    "process",
    "process-status-name",
    "process-uid",
    "raw-string",
    "register-content",
    "return-location",
    "roi-class",
    "roi-kind",
    "roi-scope",
    "row-number",
    "sched-event",
    "shader-compiler-name",
    "short-string",
    "signpost-name",
    "size-in-pixels",
    "size-in-pts",
    "sockaddr",
    "state",
    "string",
    "string-value",
    "subsystem",
    "swift-actor",
    "swift-actor-class",
    "swift-actor-id",
    "swift-task",
    "swift-task-id",
    "swift-task-name",
    "swift-task-priority",
    "swift-task-state",
    "syscall",
    "text-address",
    "text-addresses",
    "text-backtrace",
    "text-location",
    "text-symbol",
    "thermal-state",
    "thread",
    "thread-name",
    "thread-state",
    "tid",
    "time-sample-kind",
    "uint64-array",
    "uint64-hex-lowercase",
    "urlsession",
    "uuid",
    "visual-uuid-chain",
    "vm-op",
    "vr-event-name",
    "vsync-event",
    "word-string",
    "work-task-identifier",
    "xr-client-event-name",
    "xr-server-event-name",
    "xr-source-name",
]

# Types whose largest value means missing, with their width in bits where it is known.
MAX_SENTINELS = {
    "abstract-power": 5,
    "account-numeric-identifier": 8,
    "boolean": 2,
    "cfrunloop-result": 3,
    "clock": 50,
    "containment-level": 9,
    "core": 16,
    "counters-formula-result": None,
    "cpu-event-counter": 64,
    "cpu-percent-loads": None,
    "cycle-weight": None,
    "disk-size-in-bytes": None,
    "displayed-surface-io-surface": None,
    "displayed-surface-swap": None,
    "event-count": None,
    "event-time": 50,
    "events-per-second": None,
    "fd": None,
    "gpu-frame-number": None,
    "http-status": 10,
    "narrative-certainty": 7,
    "narrative-significance": 3,
    "network-size-in-bytes": None,
    "network-size-in-bytes-per-second": None,
    "nominal-sampling-frequency": None,
    "over-one-ratio": None,
    "packed-identifier": 22,
    "percent": None,
    "pid": 17,
    "pmc-event": None,
    "process-gid": None,
    "process-uid": None,
    "render-buffer-depth": None,
    "sample-count": None,
    "sample-time": 50,
    "sampling-frequency": None,
    "sched-priority": None,
    "size-in-bytes": None,
    "size-in-bytes-per-second": None,
    "size-in-pages": None,
    "start-time": 50,
    "syscall-return": None,
    "system-cpu-percent": None,
    "tid": None,
    "time-of-day": 50,
    "time-sample-kind": 16,
    "vsync-timestamp": 50,
    "weight": None,
    "work-task-identifier": 24,
}

# Types whose zero means missing.
ZERO_SENTINELS = [
    "duration",
    "duration-on-core",
    "duration-waiting",
    "os-signpost-identifier",
]
