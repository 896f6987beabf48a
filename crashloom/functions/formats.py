"""Patterns of logs and traces.

Fixed values: they are what programs, sanitizers and debuggers print. Where an alternation of lines would stand under a star,
``[\\s\\S]`` stands for it, as the JVM's regular expressions overflow their stack otherwise.
"""

#: A frame or a marker of repeats in a Python traceback.
PYTHON_LINE = r'File ".+", line [\d]+, in .+|\[Previous line repeated (\d+) more times\]'
#: The goroutine that failed.
GO_ROUTINE = r"goroutine [0-9]+ (?:\[running.*\]|\[syscall\]):"
#: A fuzzer's own error behind a trace.
FUZZER_ERROR = r"==\d+== ERROR: "
#: An exception of Java with its frames.
JAVA_BLOCK = r"(?m)^(?:Caused by:|Exception in thread|== Java Exception:)[\s\S]*?(?:\n\s+at .*\(.*\))+(?:\n\s+\.\.\. \d+ more)?"
#: The frames at its end.
JAVA_FRAMES = r"((?:\n\s+at .*\(.*\))+)(?:\n\s+\.\.\. (\d+) more)?\z"
#: How many frames it shares with the one around it.
JAVA_MORE = r"\n\s+\.\.\. (\d+) more\z"
#: An error of JavaScript with its frames.
JS_BLOCK = r"(?m)^(?:.*Error:[\s\S]*?|Thrown at:\n*?)((?:\n\s*at \S+.*)+)"
#: An exception of C# with its frames.
CSHARP_BLOCK = r"(?m)^Unhandled [Ee]xception(?::\n|\. )[\s\S]*?((?:[ \n\t]*(?:at [\S ]+|--- End of inner exception stack trace ---))+)$"
#: A frame of a Rust backtrace.
RUST_FRAME = r" *\d+: *0x[0-9a-f]+ - .*\n(?: *at .*\n)?"
#: An error of Lua with its traceback.
LUA_BLOCK = r"\S+: .+\n\s*stack traceback:\s*\n[\s\S]*.+: .+"
#: A frame of it.
LUA_LINE = r".+: in .+"
#: A warning of undefined behaviour.
UBSAN_WARNING = r".+: runtime error: [\s\S]*?SUMMARY: UndefinedBehaviorSanitizer: .*"
#: The first line of a sanitizer's report.
SANITIZER_HEAD = r"==\d+==\s*ERROR: (LeakSanitizer|AddressSanitizer|libFuzzer):"
#: The same of uninitialised memory.
MSAN_HEAD = r"==\d+==\s*WARNING: MemorySanitizer:"
#: The first line of an exception of C#.
CSHARP_HEAD = r"^Unhandled [Ee]xception(?:\. .*|:\s*$)"
#: What a sanitizer calls its finding.
SUMMARY = r"SUMMARY: *(AddressSanitizer|libFuzzer): ([A-Za-z_\-\(\)]+)"
#: What a warning of undefined behaviour says.
UBSAN_TEXT = r".+: runtime error: (.+)"
#: And what it is called.
UBSAN_SUMMARY = r"SUMMARY: UndefinedBehaviorSanitizer: ([A-Za-z_\-\(\)]+)"
#: What an error of Lua says.
LUA_ERROR = r"\S+:(?: .+:)? (.+)"
#: The type of an exception of C++.
CPP_ERROR = r"terminate called after throwing an instance of (.+)"
#: And what it says.
CPP_WHAT = r"what\(\): +(.+)"
#: Type and text of an exception of Python.
PYTHON_ERROR = r"(\w+): (.+)"
#: Of Java.
JAVA_ERROR = r"(?:Caused by: |Exception in thread .*? |== Java Exception: )(?:(\S+?): )?(.+)"
#: Of Go.
GO_ERROR = r"(runtime error:|panic:|fatal error:) (.+)"
#: Of JavaScript.
JS_ERROR = r"(?m)^.*?(\S*Error):(?:\s+(.*))?$"
#: Of C#.
CSHARP_ERROR = r"(?m)^Unhandled [Ee]xception(:\n|\. )([\s\S]*?)\n[ \t]*(?:at [\S ]+|--- End of inner exception stack trace ---)$"
#: Of Rust, in the old and the new form.
RUST_ERROR = r"thread '.+?' (\(\d+\) |)panicked at (?:'(.*)'|.+?:\n(.*))"
#: A frame of Python.
PYTHON_FRAME = r'File "(.+)", line (\d+), in (.+)'
#: Its repeats.
PYTHON_REPEATS = r"^\[Previous line repeated (\d+) more times\]"
#: A frame of C#.
CSHARP_FRAME = r"^at (\([\S ]+?\) )?(\S+?)(?: ?(\([\S ]*?\)))?(?: <(\w+)(?: \+ (\w+))?>| \[(\w+)\])?(?: in (?:<(\p{XDigit}+)(?:#\p{XDigit}+)?>|([\S ]+)):(?:line )?(\w+))?$"
#: Frames of JavaScript: with a function.
JS_FULL = r"^\s*at\s+(.+?)(?:\s+(\[as.*?\])?\s*)\((.*)\)$"
#: Without.
JS_BARE = r"^\s*at\s+(.+?)(?:(?:\s+(\[as.*?\]))?\s*)$"
#: From evaluated text.
JS_EVAL = r"^\s*at eval \(eval at (?:(.+?) (?:(\[as.*?\]) )?\((.*?)\)|(.+?)), (.*?)\)$"
#: A mapped file as the debugger lists it.
MAP_LINE = r"^\s*0x([0-9a-f]+)\s+0x([0-9a-f]+)\s+0x[0-9a-f]+\s+0x([0-9a-f]+)\s+(?:[rwxps-]{3,5}\s+)?(\S.*)$"
#: Where a warning of undefined behaviour is.
UBSAN_PLACE = r"^(.+?):(\d+):(?:(\d+):)? runtime error: "
