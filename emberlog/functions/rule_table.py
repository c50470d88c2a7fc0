"""The built-in parse rules: wrapper formats that hide the real message of a line.

A rule is data: ``order``, a ``pattern`` with named groups and the ``output`` templates. Users
pass their own list of the same shape.
"""

# Patterns and output templates of the built-in rules.
BUILTIN_RULES = [
    {
        "id": "k8s-klog",
        "order": 5,
        "pattern": r"^(?<lvl>[IWEF])(?<mmdd>\d{4})\s+(?<time>\d{2}:\d{2}:\d{2}\.\d+)\s+(?<thread>\d+)\s+(?<file>\S+)\]\s+(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}", "fields": {"file": "${file}", "thread": "${thread}"}},
    },
    {
        "id": "java-log4j",
        "order": 6,
        "pattern": r"^(?<timestamp>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d+)\s+(?<lvl>TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\s+\[(?<thread>[^\]]+)\]\s+(?<logger>\S+)\s+-\s+(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}", "source": "${logger}", "fields": {"thread": "${thread}"}},
    },
    {
        "id": "python-logging",
        "order": 7,
        "pattern": r"^(?<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[.,]\d+)\s+-\s+(?<logger>\S+)\s+-\s+(?<lvl>DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL)\s+-\s+(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}", "source": "${logger}"},
    },
    {
        "id": "android-logcat",
        "order": 8,
        "pattern": r"^(?<lvl>[VDIWEF])/(?<tag>[^\s\(]+)\s*\(\s*(?<pid>\d+)\):\s*(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}", "fields": {"tag": "${tag}", "pid": "${pid}"}},
    },
    {
        "id": "ios-nslog",
        "order": 9,
        "pattern": r"^(?<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(?<proc>\S+)\[(?<pid>\d+):(?<tid>[0-9a-fx]+)\]\s+(?<body>.*)$",
        "output": {"source": "${proc}", "msg": "${body}", "fields": {"pid": "${pid}", "tid": "${tid}"}},
    },
    {
        "id": "rust-tracing-fmt",
        "order": 10,
        "pattern": r"^(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)\s+(?<lvl>TRACE|DEBUG|INFO|WARN|ERROR)\s+(?<target>[\w:]+):\s+(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}", "source": "${target}"},
    },
    {
        "id": "rust-tracing",
        "order": 11,
        "pattern": r"^\[(?<timestamp>\S+)\s+(?<lvl>TRACE|DEBUG|INFO|WARN|ERROR)\s+(?<module>\S+)\]\s+(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}", "source": "${module}"},
    },
    {
        "id": "syslog-rfc3164",
        "order": 12,
        "pattern": r"^<(?<pri>\d+)>(?<timestamp>\w{3}\s+\d+\s+\d+:\d+:\d+)\s+(?<host>\S+)\s+(?<prog>[^\[\s:]+)(?:\[(?<pid>\d+)\])?:\s+(?<body>.*)$",
        "output": {"source": "${prog}", "msg": "${body}", "fields": {"host": "${host}", "pid": "${pid}"}},
    },
    {
        "id": "docker-cri",
        "order": 13,
        "pattern": r"^(?<timestamp>\S+)\s+(?<stream>stdout|stderr)\s+[FP]\s+(?<body>.*)$",
        "output": {"msg": "${body}", "fields": {"stream": "${stream}"}},
    },
    {
        "id": "turbo",
        "order": 14,
        "pattern": r"^(?<pkg>@?[\w./-]+):(?<script>[\w-]+):\s?(?<body>.*)$",
        "output": {"source": "${pkg}", "msg": "${body}", "fields": {"script": "${script}"}},
    },
    {
        "id": "nodemon",
        "order": 15,
        "pattern": r"^\[nodemon\]\s+(?<body>.*)$",
        "output": {"msg": "${body}", "fields": {"tag": "nodemon"}},
    },
    {
        "id": "workspace-path",
        "order": 16,
        "pattern": r"^(?<pkg>@?[\w.-]+(?:/[\w.-]+)+)\s+(?<script>[\w-]+):\s?(?<body>.*)$",
        "output": {"source": "${pkg}", "msg": "${body}", "fields": {"script": "${script}"}},
    },
    {
        "id": "level-prefix",
        "order": 20,
        "pattern": r"^(?<lvl>INFO|WARN|ERROR|DEBUG|TRACE):\s+(?<body>.*)$",
        "output": {"level": "${lvl}", "msg": "${body}"},
    },
    {
        "id": "bracket-tag",
        "order": 30,
        "pattern": r"^\[(?<tag>[^\]]+)\]\s+(?<body>.*)$",
        "output": {"msg": "${body}", "fields": {"tag": "${tag}"}},
    },
    {
        "id": "trailing-json",
        "order": 40,
        "pattern": r"^(?<body>.*?)\s+(?<json>\{.*\})\s*$",
        "output": {"msg": "${body}", "merge_fields": "${json}"},
    },
]

# Shapes of a stack-frame line in the common runtimes.
FRAME_SHAPES = [
    r"^at\s+\S+\s*\([^)]*\.\w{1,8}:\d+",
    r"^at\s+[\w./-]+\.\w{1,8}:\d+",
    r"^at\s+\S+\s+in\s+\S+:line\s+\d+",
    r'^File\s+"[^"]+",\s+line\s+\d+',
    r"^from\s+\S+:\d+:in\s+['`]",
    r"^panic:",
    r"^goroutine\s+\d+",
    r"^created\s+by\b",
    r"^#\d+\s+0x[0-9a-fA-F]+\s+in\s+",
    r"^#\d+\s+\S+\.php\(\d+\):",
]
