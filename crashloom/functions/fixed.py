"""Fixed values of the crash-report formats: they must be these for right results."""

#: Regular expressions of functions that are no part of a crash, by language.
IGNORED_FUNCTIONS = {
    "java": [
        r"^java\.base",
        r"^java\.lang",
        r"^java\.beans",
        r"^java\.time",
        r"^java\.math",
        r"^java\.rmi",
        r"^java\.net",
        r"^java\.security",
        r"^java\.text",
        r"^java\.awt",
        r"^java\.n?io",
        r"^javax\.",
    ],
    "js": [
        r"^<anonymous>$",
    ],
    "lua": [
        r"^[^.]$",
    ],
    "python": [
        r"^[^.]$",
    ],
    "rust": [
        r"^rust_begin_unwind",
        r"^rust_fuzzer_test_input",
        r"^rust_oom",
        r"^rust_panic",
        r"^std::io::Write::write_fmt",
        r"^std::panic",
        r"^std::process::abort",
        r"^__rust_start_panic",
        r"^core::fmt::write",
        r"^core::panicking",
        r"^core::result",
        r"^panic_abort::",
        r"^__rust_try",
    ],
    "go": [
        r"^runtime\.",
    ],
    "cpp": [
        r"^abort$",
        r"^exit$",
        r"^pthread_create$",
        r"^pthread_kill$",
        r"^raise$",
        r"^tgkill$",
        r"^__chk_fail$",
        r"^__fortify_fail$",
        r"^(|__)aeabi_",
        r"^(|__)memcmp",
        r"^(|__)memcpy",
        r"^(|__)memmove",
        r"^(|__)memset",
        r"^(|__)strcmp",
        r"^(|__)strcpy",
        r"^(|__)strdup",
        r"^(|__)strlen",
        r"^(|__)strncpy",
        r"^<null>",
        r"^Abort\(",
        r"^CFCrash",
        r"^ExitCallback",
        r"^IsSandboxedProcess",
        r"^MSanAtExitWrapper",
        r"^New",
        r"^RaiseException",
        r"^SbSystemBreakIntoDebugger",
        r"^SignalAction",
        r"^SignalHandler",
        r"^TestOneProtoInput",
        r"^WTF::",
        r"^WTFCrash",
        r"^X11Error",
        r"^_L_unlock_",
        r"^__GI_",
        r"^__asan::",
        r"^__asan_",
        r"^__assert_",
        r"^__cxa_atexit",
        r"^__cxa_rethrow",
        r"^__cxa_throw",
        r"^throw_exception",
        r"^__dump_stack",
        r"^__hwasan::",
        r"^__hwasan_",
        r"^__interceptor_",
        r"^__kasan_",
        r"^__libc_",
        r"^__lsan::",
        r"^__lsan_",
        r"^__msan::",
        r"^__msan_",
        r"^__pthread_kill",
        r"^__run_exit_handlers",
        r"^__rust_try",
        r"^__sanitizer::",
        r"^__sanitizer_",
        r"^__tsan::",
        r"^__tsan_",
        r"^__ubsan::",
        r"^__ubsan_",
        r"^_asan_",
        r"^_hwasan_",
        r"^_lsan_",
        r"^_msan_",
        r"^_objc_terminate",
        r"^_sanitizer_",
        r"^_start",
        r"^__libc_start_main",
        r"^_tsan_",
        r"^_ubsan_",
        r"^abort",
        r"^alloc::",
        r"^android\.app\.ActivityManagerProxy\.",
        r"^android\.os\.Parcel\.",
        r"^art::Thread::CreateNativeThread",
        r"^asan_",
        r"^asan\.module_ctor",
        r"^asan\.module_dtor",
        r"^calloc",
        r"^check_memory_region",
        r"^common_exit",
        r"^delete",
        r"^demangling_terminate_handler",
        r"^bt_terminate_handler",
        r"^dump_backtrace",
        r"^dump_stack",
        r"^exit_or_terminate_process",
        r"^fpehandler\(",
        r"^free",
        r"^g_log",
        r"^generic_cpp_",
        r"^gsignal",
        r"^kasan_",
        r"^fuzzer::",
        r"^libfuzzer_sys::initialize",
        r"^malloc",
        r"^mozalloc_",
        r"^new",
        r"^object_err",
        r"^operator",
        r"^print_trailer",
        r"^realloc",
        r"^report_failure",
        r"^scanf",
        r"^show_stack",
        r"^std::__terminate",
        r"^std::terminate",
        r"^std::sys::unix::abort",
        r"^std::sys_common::backtrace",
        r"^__scrt_common_main_seh",
        r".*ASAN_OnSIGSEGV",
        r".*BaseThreadInitThunk",
        r".*DebugBreak",
        r".*DefaultDcheckHandler",
        r".*ForceCrashOnSigAbort",
        r".*MemoryProtection::CMemoryProtector",
        r".*PartitionAlloc",
        r".*RtlFreeHeap",
        r".*RtlInitializeExceptionChain",
        r".*RtlReportCriticalFailure",
        r".*RtlUserThreadStart",
        r".*RtlpHeapHandleError",
        r".*RtlpLogHeapFailure",
        r".*SkDebugf",
        r".*StackDumpSignalHandler",
        r".*__android_log_assert",
        r".*__tmainCRTStartup",
        r".*_asan_rtl_",
        r".*agent::asan::",
        r".*allocator_shim",
        r".*asan_Heap",
        r".*asan_check_access",
        r".*asan_osx_dynamic\.dylib",
        r".*assert",
        r".*base::FuzzedDataProvider",
        r".*base::allocator",
        r".*base::android::CheckException",
        r".*base::debug::BreakDebugger",
        r".*base::debug::CollectStackTrace",
        r".*base::debug::StackTrace::StackTrace",
        r".*ieee754\-",
        r".*libpthread",
        r".*logger",
        r".*logging::CheckError",
        r".*logging::ErrnoLogMessage",
        r".*logging::LogMessage",
        r".*stdext::exception::what",
        r".*v8::base::OS::Abort",
        r".*pybind",
        r"^PyCFunction",
        r"^PyObject",
        r"^PyEval",
        r"^PyRun",
        r"^Py_",
        r"^atheris::",
    ],
    "csharp": [
        r"^\(wrapper",
    ],
}

#: Regular expressions of modules and source files that are no part of a crash, by language.
IGNORED_FILES = {
    "java": [
        r"^[^.]$",
    ],
    "js": [
        r"^<anonymous>$",
        r"^native$",
        r"^(|node:)internal/?",
        r"^(|node:)events/?",
        r"node_modules/@jazzer.js",
        r"node_modules/jsfuzz",
    ],
    "lua": [
        r"^[^.]$",
    ],
    "python": [
        r"^[^.]$",
    ],
    "rust": [
        r".*/rust(|c)/",
        r".*/afl-.*/.*\.rs",
        r".*/libfuzzer-sys-.*/.*\.rs",
    ],
    "go": [
        r".*go/src/runtime/",
    ],
    "cpp": [
        r".*/usr/include/c\+\+/",
        r".*\-gnu/c\+\+/",
        r".*\-gnu/bits/",
        r".*/clang/",
        r".*base/callback",
        r".*/AOSP\-toolchain/",
        r".*/bindings/ToV8\.h",
        r".*/crosstool/",
        r".*/gcc/",
        r".*sysdeps/",
        r".*/glibc\-",
        r".*/jemalloc/",
        r".*/libc\+\+",
        r".*/libc/",
        r".*/llvm\-build/",
        r".*/minkernel/crts/",
        r".*/sanitizer_common/",
        r".*/tcmalloc/",
        r".*/vc/include/",
        r".*/vctools/crt/",
        r".*/win_toolchain/",
        r".*libc\+\+/",
        r".*/cxxsupp/",
        r".*/util/generic/",
        r".*/compiler\-rt/lib/",
        r".*/libfuzzer/lib/",
        r".*/clang.*\-rt/lib/",
        r".*\+Unknown",
        r".*<unknown module>",
        r".*Inline Function @",
        r"^<unknown>$",
        r"^\[vdso\]$",
        r"^linux-vdso.so.*$",
        r"^linux-gate.so.*$",
        r".*libc\.so",
        r".*libc\+\+\.so",
        r".*libc\+\+_shared\.so",
        r".*libstdc\+\+\.so",
        r".*libc-.*\.so",
        r".*libpthread\.so",
        r".*libasan\.so",
        r".*libubsan\.so",
        r".*asan_with_fuzzer\.so",
    ],
    "csharp": [
        r"^[^.]$",
    ],
}

#: Severity classes as (type, short description, description, explanation); an entry's place is its rule number.
SEVERITIES = [
    ("EXPLOITABLE", "SegFaultOnPc", "Segmentation fault on program counter", "The target tried to access data at an address that matches the program counter. This likely indicates that the program counter contents are tainted and can be controlled by an attacker."),
    ("EXPLOITABLE", "ReturnAv", "Access violation during return instruction", "The target crashed on a return instruction, which likely indicates stack corruption."),
    ("EXPLOITABLE", "BranchAv", "Access violation during branch instruction", "The target crashed on a branch instruction, which may indicate that the control flow is tainted."),
    ("EXPLOITABLE", "CallAv", "Access violation during call instruction", "The target crashed on a call instruction, which may indicate that the control flow is tainted."),
    ("EXPLOITABLE", "DestAv", "Access violation on destination operand", "The target crashed on an access violation at an address matching the destination operand of the instruction. This likely indicates a write access violation, which means the attacker may control the write address and/or value."),
    ("EXPLOITABLE", "BranchAvTainted", "Access violation during branch instruction from tainted source", "The target crashed on loading from memory (SourceAv). After taint tracking, target operand of branch instruction could be tainted."),
    ("EXPLOITABLE", "CallAvTainted", "Access violation during call instruction from tainted source", "The target crashed on loading from memory (SourceAv). After taint tracking, target operand of call instruction could be tainted."),
    ("EXPLOITABLE", "DestAvTainted", "Access violation on destination operand from tainted source", "The target crashed on loading from memory (SourceAv). After taint tracking, address operand of memory store instruction could be tainted. This likely indicates a write access violation, which means the attacker may control the write address and/or value."),
    ("NOT_EXPLOITABLE", "AbortSignal", "Abort signal", "The target is stopped on a SIGABRT. SIGABRTs are often generated by libc and compiled check-code to indicate potentially exploitable conditions."),
    ("NOT_EXPLOITABLE", "TrapSignal", "Trap signal", "The target is stopped on a SIGTRAP. The SIGTRAP signal is sent to a process when an exception (or trap) occurs: a condition that a debugger has requested to be informed of – for example, when a particular function is executed, or when a particular variable changes value. "),
    ("NOT_EXPLOITABLE", "AccessViolation", "Access violation", "The target crashed due to an access violation but there is not enough additional information available to determine exploitability. Manual analysis is needed."),
    ("NOT_EXPLOITABLE", "SourceAv", "Access violation on source operand", "The target crashed on an access violation at an address matching the source operand of the current instruction. This likely indicates a read access violation."),
    ("PROBABLY_EXPLOITABLE", "BadInstruction", "Bad instruction", "The target tried to execute a malformed or privileged instruction. This may indicate that the control flow is tainted."),
    ("PROBABLY_EXPLOITABLE", "SegFaultOnPcNearNull", "Segmentation fault on program counter near NULL", "The target tried to access data at an address that matches the program counter. This may indicate that the program counter contents are tainted, however, it may also indicate a simple NULL dereference."),
    ("PROBABLY_EXPLOITABLE", "BranchAvNearNull", "Access violation near NULL during branch instruction", "The target crashed on a branch instruction, which may indicate that the control flow is tainted. However, there is a chance it could be a NULL dereference."),
    ("PROBABLY_EXPLOITABLE", "CallAvNearNull", "Access violation near NULL during call instruction", "The target crashed on a call instruction, which may indicate that the control flow is tainted. However, there is a chance it could be a NULL dereference."),
    ("PROBABLY_EXPLOITABLE", "DestAvNearNull", "Access violation near NULL on destination operand", "The target crashed on an access violation at an address matching the destination operand of the instruction. This likely indicates a write access violation, which means the attacker may control write address and/or value. However, it there is a chance it could be a NULL dereference."),
    ("NOT_EXPLOITABLE", "SourceAvNearNull", "Access violation near NULL on source operand", "The target crashed on an access violation at an address matching the source operand of the current instruction. This likely indicates a read access violation, which may mean the application crashed on a simple NULL dereference to data structure that has no immediate effect on control of the processor."),
    ("PROBABLY_EXPLOITABLE", "StackGuard", "Stack buffer overflow", "The target program is aborted due to stack cookie overwrite."),
    ("NOT_EXPLOITABLE", "SafeFunctionCheck", "Safe function check guard", "The target program is aborted due to safe function check guard: _chk()."),
    ("PROBABLY_EXPLOITABLE", "HeapError", "Heap error", "The target program is aborted due to error produced by heap allocator functions."),
    ("NOT_EXPLOITABLE", "FPE", "Arithmetic exception", "The target crashed due to arithmetic floating point exception."),
    ("NOT_EXPLOITABLE", "StackOverflow", "Stack overflow", "The target crashed on an access violation where the faulting instruction's mnemonic and the stack pointer seem to indicate a stack overflow."),
    ("UNDEFINED", "Undefined", "Undefined class", "There is no execution class for this type of exception."),
    ("NOT_EXPLOITABLE", "double-free", "Deallocation of freed memory", "The target crashed while trying to deallocate already freed memory."),
    ("NOT_EXPLOITABLE", "bad-free", "Invalid memory deallocation", "The target crashed on attempting free on address which was not malloc()-ed."),
    ("NOT_EXPLOITABLE", "alloc-dealloc-mismatch", "Invalid use of alloc/dealloc functions", "Mismatch between allocation and deallocation APIs."),
    ("NOT_EXPLOITABLE", "unknown-crash", "Sanitizer check fail", "Invalid memory access."),
    ("NOT_EXPLOITABLE", "heap-buffer-overflow(read)", "Heap buffer overflow", "The target reads data past the end, or before the beginning, of the intended heap buffer."),
    ("PROBABLY_EXPLOITABLE", "heap-buffer-overflow", "Heap buffer overflow", "The target attempts to read or write data past the end, or before the beginning, of the intended heap buffer."),
    ("EXPLOITABLE", "heap-buffer-overflow(write)", "Heap buffer overflow", "The target writes data past the end, or before the beginning, of the intended heap buffer."),
    ("NOT_EXPLOITABLE", "dynamic-stack-buffer-overflow(read)", "Dynamic stack buffer overflow", "The target reads data past the end, or before the beginning, of the variable-length array (VLA)."),
    ("PROBABLY_EXPLOITABLE", "dynamic-stack-buffer-overflow", "Dynamic stack buffer overflow", "The target attempts to read or write data past the end, or before the beginning, of the variable-length array (VLA)."),
    ("EXPLOITABLE", "dynamic-stack-buffer-overflow(write)", "Dynamic stack buffer overflow", "The target writes data past the end, or before the beginning, of the variable-length array (VLA)."),
    ("NOT_EXPLOITABLE", "global-buffer-overflow(read)", "Global buffer overflow", "The target reads data past the end, or before the beginning, of the intended global buffer."),
    ("PROBABLY_EXPLOITABLE", "global-buffer-overflow", "Global buffer overflow", "The target attempts to read or write data past the end, or before the beginning, of the intended global buffer."),
    ("EXPLOITABLE", "global-buffer-overflow(write)", "Global buffer overflow", "The target writes data past the end, or before the beginning, of the intended global buffer."),
    ("NOT_EXPLOITABLE", "stack-use-after-scope(read)", "Use of out-of-scope stack memory", "The target crashed when reading from a stack address outside the lexical scope of a variable's lifetime."),
    ("PROBABLY_EXPLOITABLE", "stack-use-after-scope", "Use of out-of-scope stack memory", "The target crashed when using a stack address outside the lexical scope of a variable's lifetime."),
    ("EXPLOITABLE", "stack-use-after-scope(write)", "Use of out-of-scope stack memory", "The target crashed when writing on a stack address outside the lexical scope of a variable's lifetime."),
    ("PROBABLY_EXPLOITABLE", "use-after-poison", "Using poisoned memory", "The target crashed on trying to use the memory that was previously poisoned."),
    ("NOT_EXPLOITABLE", "stack-use-after-return(read)", "Use of stack memory after return", "The target crashed when reading from a stack memory of a returned function."),
    ("PROBABLY_EXPLOITABLE", "stack-use-after-return", "Use of stack memory after return", "The target crashed when using a stack memory of a returned function."),
    ("EXPLOITABLE", "stack-use-after-return(write)", "Use of stack memory after return", "The target crashed when writing to a stack memory of a returned function."),
    ("NOT_EXPLOITABLE", "stack-buffer-overflow(read)", "Stack buffer overflow", "The target reads data past the end, or before the beginning, of the intended stack buffer."),
    ("PROBABLY_EXPLOITABLE", "stack-buffer-overflow", "Stack buffer overflow", "The target attempts to read or write data past the end, or before the beginning, of the intended stack buffer."),
    ("EXPLOITABLE", "stack-buffer-overflow(write)", "Stack buffer overflow", "The target writes data past the end, or before the beginning, of the intended stack buffer."),
    ("NOT_EXPLOITABLE", "initialization-order-fiasco", "Bad initialization order", "Initializer for a global variable accesses dynamically initialized global from another translation unit, which is not yet initialized."),
    ("NOT_EXPLOITABLE", "stack-buffer-underflow(read)", "Stack buffer underflow", "The target reads from a buffer using buffer access mechanisms such as indexes or pointers that reference memory locations prior to the targeted buffer."),
    ("PROBABLY_EXPLOITABLE", "stack-buffer-underflow", "Stack buffer underflow", "The target is using buffer with an index or pointer that references a memory location prior to the beginning of the buffer."),
    ("EXPLOITABLE", "stack-buffer-underflow(write)", "Stack buffer underflow", "The target writes to a buffer using an index or pointer that references a memory location prior to the beginning of the buffer."),
    ("NOT_EXPLOITABLE", "heap-use-after-free(read)", "Use of deallocated memory", "The target crashed when reading from memory after it has been freed."),
    ("PROBABLY_EXPLOITABLE", "heap-use-after-free", "Use of deallocated memory", "The target crashed when using memory after it has been freed."),
    ("EXPLOITABLE", "heap-use-after-free(write)", "Use of deallocated memory", "The target crashed when writing to memory after it has been freed."),
    ("NOT_EXPLOITABLE", "container-overflow(read)", "Container overflow", "The target crashed when reading from memory inside the allocated heap region but outside of the current container bounds."),
    ("PROBABLY_EXPLOITABLE", "container-overflow", "Container overflow", "The target crashed when using memory inside the allocated heap region but outside of the current container bounds."),
    ("EXPLOITABLE", "container-overflow(write)", "Container overflow", "The target crashed when writing to memory inside the allocated heap region but outside of the current container bounds."),
    ("NOT_EXPLOITABLE", "new-delete-type-mismatch", "Invalid use of new/delete functions", "Deallocation size different from allocation size."),
    ("NOT_EXPLOITABLE", "bad-malloc_usable_size", "Bad function use", "Invalid argument to malloc_usable_size."),
    ("EXPLOITABLE", "param-overlap", "Overlapping memory ranges", "Call to function disallowing overlapping memory ranges."),
    ("PROBABLY_EXPLOITABLE", "negative-size-param", "Use of negative size", "Negative size used when accessing memory."),
    ("NOT_EXPLOITABLE", "odr-violation", "Multiple symbol definition", "Symbol defined in multiple translation units."),
    ("NOT_EXPLOITABLE", "memory-leaks", "Memory leaks", "The target does not sufficiently track and release allocated memory after it has been used, which slowly consumes remaining memory."),
    ("PROBABLY_EXPLOITABLE", "calloc-overflow", "Calloc parameters overflow", "Overflow in calloc parameters."),
    ("PROBABLY_EXPLOITABLE", "reallocarray-overflow", "Realloc parameters overflow", "Overflow in realloc parameters."),
    ("PROBABLY_EXPLOITABLE", "pvalloc-overflow", "Pvalloc parameters overflow", "Overflow in pvalloc parameters."),
    ("NOT_EXPLOITABLE", "invalid-allocation-alignment", "Invalid alignment", "Invalid allocation alignment."),
    ("NOT_EXPLOITABLE", "invalid-aligned-alloc-alignment", "Invalid alignment", "Invalid alignment requested in aligned_alloc."),
    ("NOT_EXPLOITABLE", "invalid-posix-memalign-alignment", "Invalid alignment", "Invalid alignment requested in posix_memalign."),
    ("NOT_EXPLOITABLE", "allocation-size-too-big", "Allocation size too big", "Requested allocation size exceeds maximum supported size."),
    ("NOT_EXPLOITABLE", "out-of-memory", "Memory limit exceeded", "The target has exceeded the memory limit."),
    ("NOT_EXPLOITABLE", "fuzz target exited", "Fuzz target exited", "Fuzz target exited."),
    ("NOT_EXPLOITABLE", "timeout", "Target timeout expired", "Timeout after several seconds."),
    ("PROBABLY_EXPLOITABLE", "overwrites-const-input", "Attempt to overwrite constant input", "Fuzz target overwrites its constant input."),
    ("NOT_EXPLOITABLE", "use-of-uninitialized-value", "Use of uninitialized value", "The target attempted to access memory that was not initialized."),
]

#: The class of a report without one.
UNDEFINED = ("UNDEFINED", "Undefined", "Undefined class", "There is no execution class for this type of exception")

#: Signal numbers.
SIGILL, SIGTRAP, SIGABRT, SIGBUS, SIGFPE, SIGSEGV, SIGSYS = 4, 5, 6, 7, 8, 11, 31
#: Fixed value: the code of a signal that the kernel raised.
SI_KERNEL = 0x80

#: Coefficients of trace similarity, and the distance from which clusters don't merge.
DEPTH, SHIFT, THRESHOLD = 0.04, 0.13, 0.3

#: Fixed value: addresses below are near null.
NEAR_NULL = 64 * 1024

#: Environment entries that are left out of reports.
SENSITIVE_ENV = [
    "^CI=", "^HOSTNAME=", "^LOGNAME=", "^USERNAME=", "^LANG=", "^SESSION_MANAGER=", "^XAUTHORITY=", "^CI_", "^GITLAB_", "^FF_", "^LC_", "^SSH_", "^XDG_",
    "^GTK_", "^GIO_", "^DESKTOP_", "^DBUS_", "^GNOME_", "^TERMINATOR_", "^GPG_", "^LS_COLORS=", "^LESSCLOSE=", "^LESSOPEN=", "KEY", "PASSWORD", "TOKEN",
]

#: Fixed value: the fuzzers' entry point; frames outside of it don't count.
FUZZ_ENTRY = "LLVMFuzzerTestOneInput"

#: Report columns in the order in which they choose the trace's format.
FORMATS = [
    ("asan", ["AsanReport", "MsanReport"]), ("python", ["PythonReport"]), ("java", ["JavaReport"]), ("go", ["GoReport"]), ("rust", ["RustReport"]),
    ("js", ["JsReport"]), ("csharp", ["CSharpReport"]), ("lua", ["LuaReport"]),
]

#: The languages whose ignore lists each kind of use takes.
CLUSTER_LANGS = ("cpp", "csharp", "go", "java", "js", "python", "rust")
SARIF_LANGS = ("cpp", "rust", "python", "go", "java", "js")
