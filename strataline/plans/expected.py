"""What the catalogues must say, written out for the SQL side: a changed constant in `operators.catalog` shows as a
difference between a query and its SQL instead of changing both."""

# Record type, priority, category, opening pattern, closing pattern.
RECORD_TYPES = r"""
('header', 'LOW', 'meta', '^==+$', '^------ MEMORY INFO'),
('memory_info', 'MEDIUM', 'system', '^------ MEMORY INFO', '^------ \d+\.\d+s was the duration of ''MEMORY INFO'''),
('vmstat', 'LOW', 'system', '^------ VIRTUAL MEMORY STATS', '^------ \d+\.\d+s was the duration of ''VIRTUAL MEMORY STATS'''),
('binder_failed_transaction', 'HIGH', 'binder', '^------ BINDER FAILED TRANSACTION LOG', '^------ \d+\.\d+s was the duration of ''BINDER FAILED TRANSACTION LOG'''),
('binder_transaction', 'HIGH', 'binder', '^------ BINDER TRANSACTION LOG', '^------ \d+\.\d+s was the duration of ''BINDER TRANSACTION LOG'''),
('binder_stats', 'MEDIUM', 'binder', '^------ BINDER STATS', '^------ \d+\.\d+s was the duration of ''BINDER STATS'''),
('binder_state', 'HIGH', 'binder', '^------ BINDER STATE', '^------ \d+\.\d+s was the duration of ''BINDER STATE'''),
('dumpsys_critical', 'CRITICAL', 'dumpsys', '^------ DUMPSYS CRITICAL', '^------ \d+\.\d+s was the duration of ''DUMPSYS CRITICAL'''),
('dumpsys_high', 'HIGH', 'dumpsys', '^------ DUMPSYS HIGH', '^------ \d+\.\d+s was the duration of ''DUMPSYS HIGH'''),
('dumpsys_normal', 'MEDIUM', 'dumpsys', '^------ DUMPSYS NORMAL', '^------ (SYSTEM LOG|LOGCAT|KERNEL LOG|SERIALIZE PERFETTO TRACE)'),
('dumpsys_sepunion', 'HIGH', 'dumpsys', '^##### .+ #####$', '^#####|^------'),
('system_log', 'CRITICAL', 'logcat', '^------ SYSTEM LOG', '^------ \d+\.\d+s was the duration of ''SYSTEM LOG'''),
('event_log', 'HIGH', 'logcat', '^------ EVENT LOG', '^------ \d+\.\d+s was the duration of ''EVENT LOG'''),
('stats_log', 'MEDIUM', 'logcat', '^------ STATS LOG', '^------ \d+\.\d+s was the duration of ''STATS LOG'''),
('radio_log', 'HIGH', 'logcat', '^------ RADIO LOG', '^------ \d+\.\d+s was the duration of ''RADIO LOG'''),
('kernel_log', 'HIGH', 'kernel', '^------ KERNEL LOG', '^------ \d+\.\d+s was the duration of ''KERNEL LOG'''),
('kernel_ap_klog', 'MEDIUM', 'kernel', '^------ KERNEL AP_KLOG', '^------ BINDER FAILED'),
('last_kmsg', 'HIGH', 'kernel', '^------ LAST KMSG', '^------ \d+\.\d+s was the duration of ''LAST KMSG'''),
('vm_traces_just_now', 'CRITICAL', 'traces', '^------ VM TRACES JUST NOW', '^------ \d+\.\d+s was the duration of ''VM TRACES JUST NOW'''),
('vm_traces_anr', 'CRITICAL', 'traces', '^------ VM TRACES AT LAST ANR', '^------ (ANR FILES|OLOG)'),
('anr_files', 'CRITICAL', 'traces', '^------ ANR FILES', '^------ \d+\.\d+s was the duration of ''ANR FILES'''),
('process_traces', 'CRITICAL', 'traces', '^----- pid \d+ at \d{4}-\d{2}-\d{2}', '^----- (end|pid|Waiting)'),
('system_properties', 'MEDIUM', 'system', '^------ SYSTEM PROPERTIES', '^------ \d+\.\d+s was the duration of ''SYSTEM PROPERTIES'''),
('cpu_info', 'MEDIUM', 'system', '^------ CPU INFO', '^------ \d+\.\d+s was the duration of ''CPU INFO'''),
('processes_threads', 'MEDIUM', 'system', '^------ PROCESSES AND THREADS', '^------ \d+\.\d+s was the duration of ''PROCESSES AND THREADS'''),
('battery_log', 'HIGH', 'power', '^\*{3,}Battery.*\*{3,}$', '^\*{3,}|$'),
('power_off_reset', 'HIGH', 'power', '^------ POWER OFF RESET REASON', '^------ \d+\.\d+s was the duration of ''POWER OFF RESET REASON'''),
('storaged_io', 'MEDIUM', 'storage', '^------ STORAGED IO INFO', '^------ \d+\.\d+s was the duration of ''STORAGED IO INFO'''),
('filesystem_free', 'LOW', 'storage', '^------ FILESYSTEMS & FREE SPACE', '^------ \d+\.\d+s was the duration of ''FILESYSTEMS & FREE SPACE'''),
('ufs_info', 'MEDIUM', 'storage', '^------ UFS ', '^------ (USB|NFC|DISPLAY|AP)'),
('display_debug', 'MEDIUM', 'display', '^------ DISPLAY DEBUG INFO', '^------ \d+\.\d+s was the duration of ''DISPLAY DEBUG INFO'''),
('filesystem_debug', 'LOW', 'fs', '^------ FILESYSTEM DEBUG INFO', '^------ \d+\.\d+s was the duration of ''FILESYSTEM DEBUG INFO'''),
('dlog_history', 'LOW', 'fs', '^------ DLOG HISTORY', '^------ (UFS|DUMPSTATE)'),
('psi_info', 'LOW', 'system', '^------ PSI (cpu|memory|io)', '^------ \d+\.\d+s was the duration of ''PSI'),
('vmalloc_info', 'LOW', 'system', '^------ VMALLOC INFO', '^------ \d+\.\d+s was the duration of ''VMALLOC INFO'''),
('slab_info', 'LOW', 'system', '^------ SLAB INFO', '^------ \d+\.\d+s was the duration of ''SLAB INFO''')
"""

# Subsection, text, priority, category; in order.
SUBSECTIONS = """
(1, 'SurfaceFlinger', 'was the duration of dumpsys SurfaceFlinger', 'HIGH', 'graphics'),
(2, 'SurfaceFlingerAIDL', 'was the duration of dumpsys SurfaceFlingerAIDL', 'HIGH', 'graphics'),
(3, 'activity', 'was the duration of dumpsys activity', 'CRITICAL', 'system'),
(4, 'cpuinfo', 'was the duration of dumpsys cpuinfo', 'MEDIUM', 'system'),
(5, 'display', 'was the duration of dumpsys display', 'MEDIUM', 'display'),
(6, 'input', 'was the duration of dumpsys input', 'HIGH', 'input'),
(7, 'input_method', 'was the duration of dumpsys input_method', 'HIGH', 'input'),
(8, 'notification', 'was the duration of dumpsys notification', 'MEDIUM', 'notification'),
(9, 'power', 'was the duration of dumpsys power', 'HIGH', 'power'),
(10, 'sensorservice', 'was the duration of dumpsys sensorservice', 'MEDIUM', 'sensor'),
(11, 'window', 'was the duration of dumpsys window', 'HIGH', 'window'),
(12, 'meminfo', 'was the duration of dumpsys meminfo', 'HIGH', 'memory'),
(13, 'network_stack', 'was the duration of dumpsys network_stack', 'MEDIUM', 'network'),
(14, 'tethering', 'was the duration of dumpsys tethering', 'MEDIUM', 'network'),
(15, 'statusbar', 'was the duration of dumpsys statusbar', 'MEDIUM', 'ui'),
(16, 'samsungnfc', 'was the duration of dumpsys samsungnfc', 'LOW', 'nfc'),
(17, 'nfc', 'was the duration of dumpsys nfc', 'LOW', 'nfc'),
(18, 'uwb', 'was the duration of dumpsys uwb', 'LOW', 'uwb'),
(19, 'secims', 'was the duration of dumpsys secims', 'HIGH', 'security'),
(20, 'phone', 'was the duration of dumpsys phone', 'HIGH', 'telephony'),
(21, 'settings', 'was the duration of dumpsys settings', 'MEDIUM', 'settings'),
(22, 'sec_location', 'was the duration of dumpsys sec_location', 'MEDIUM', 'location'),
(23, 'audio', 'was the duration of dumpsys audio', 'HIGH', 'audio'),
(24, 'vibrator_manager', 'was the duration of dumpsys vibrator_manager', 'LOW', 'haptic'),
(25, 'wifiscanner', 'was the duration of dumpsys wifiscanner', 'MEDIUM', 'network'),
(26, 'wifi', 'was the duration of dumpsys wifi', 'HIGH', 'network'),
(27, 'sem_wifi', 'was the duration of dumpsys sem_wifi', 'HIGH', 'network'),
(28, 'vendor_wifi', 'was the duration of dumpsys vendor.samsung.hardware.wifi.ISehWifi', 'HIGH', 'network'),
(29, 'gamemanager', 'was the duration of dumpsys gamemanager', 'MEDIUM', 'gaming'),
(30, 'sdhms', 'was the duration of dumpsys sdhms', 'HIGH', 'system'),
(31, 'AODManagerService', 'was the duration of dumpsys AODManagerService', 'LOW', 'display'),
(32, 'ChimeraManagerService', 'was the duration of dumpsys ChimeraManagerService', 'LOW', 'system'),
(33, 'CocktailBarService', 'was the duration of dumpsys CocktailBarService', 'LOW', 'ui'),
(34, 'CustomFrequencyManagerService', 'was the duration of dumpsys CustomFrequencyManagerService', 'MEDIUM', 'system'),
(35, 'DualDARPolicy', 'was the duration of dumpsys DualDARPolicy', 'LOW', 'policy'),
(36, 'HardcoderService', 'was the duration of dumpsys HardcoderService', 'MEDIUM', 'performance'),
(37, 'HqmManagerService', 'was the duration of dumpsys HqmManagerService', 'LOW', 'system'),
(38, 'IntelligentBatterySaverService', 'was the duration of dumpsys IntelligentBatterySaverService', 'HIGH', 'power'),
(39, 'PkgPredictorService', 'was the duration of dumpsys PkgPredictorService', 'LOW', 'system'),
(40, 'PowerSolution_Framework_service', 'was the duration of dumpsys PowerSolution_Framework_service', 'HIGH', 'power'),
(41, 'SemService', 'was the duration of dumpsys SemService', 'MEDIUM', 'system'),
(42, 'accessibility', 'was the duration of dumpsys accessibility', 'HIGH', 'accessibility'),
(43, 'account', 'was the duration of dumpsys account', 'LOW', 'account'),
(44, 'activity_task', 'was the duration of dumpsys activity_task', 'HIGH', 'system'),
(45, 'adb', 'was the duration of dumpsys adb', 'MEDIUM', 'debug'),
(46, 'alarm', 'was the duration of dumpsys alarm', 'MEDIUM', 'alarm'),
(47, 'camera_service', 'was the duration of dumpsys android.frameworks.cameraservice.service', 'HIGH', 'camera'),
(48, 'sensor_manager', 'was the duration of dumpsys android.frameworks.sensorservice', 'MEDIUM', 'sensor'),
(49, 'stats', 'was the duration of dumpsys android.frameworks.stats', 'LOW', 'stats'),
(50, 'audio_hal', 'was the duration of dumpsys android.hardware.audio', 'HIGH', 'audio'),
(51, 'camera_provider', 'was the duration of dumpsys android.hardware.camera.provider', 'HIGH', 'camera'),
(52, 'drm_widevine', 'was the duration of dumpsys android.hardware.drm.IDrmFactory/widevine', 'HIGH', 'drm'),
(53, 'gnss', 'was the duration of dumpsys android.hardware.gnss', 'MEDIUM', 'location'),
(54, 'graphics_allocator', 'was the duration of dumpsys android.hardware.graphics.allocator', 'MEDIUM', 'graphics'),
(55, 'activity_activities', 'ACTIVITY MANAGER ACTIVITIES', 'HIGH', 'activity'),
(56, 'activity_settings', 'ACTIVITY MANAGER SETTINGS', 'MEDIUM', 'activity'),
(57, 'activity_allowed_associations', 'ACTIVITY MANAGER ALLOWED ASSOCIATION STATE', 'LOW', 'activity'),
(58, 'activity_pending_intents', 'ACTIVITY MANAGER PENDING INTENTS', 'MEDIUM', 'activity'),
(59, 'activity_broadcasts', 'ACTIVITY MANAGER BROADCAST STATE', 'CRITICAL', 'activity'),
(60, 'activity_broadcast_stats', 'ACTIVITY MANAGER BROADCAST STATS STATE', 'MEDIUM', 'activity'),
(61, 'activity_providers', 'ACTIVITY MANAGER CONTENT PROVIDERS', 'HIGH', 'activity'),
(62, 'activity_uri_permissions', 'ACTIVITY MANAGER URI PERMISSIONS', 'MEDIUM', 'activity'),
(63, 'activity_services', 'ACTIVITY MANAGER SERVICES', 'HIGH', 'activity'),
(64, 'activity_recents', 'ACTIVITY MANAGER RECENT TASKS', 'MEDIUM', 'activity'),
(65, 'activity_lastanr', 'ACTIVITY MANAGER LAST ANR', 'CRITICAL', 'activity'),
(66, 'activity_starter', 'ACTIVITY MANAGER STARTER', 'MEDIUM', 'activity'),
(67, 'activity_containers', 'ACTIVITY MANAGER CONTAINERS', 'LOW', 'activity'),
(68, 'activity_lru_processes', 'ACTIVITY MANAGER LRU PROCESSES', 'HIGH', 'activity'),
(69, 'activity_exit_info', 'ACTIVITY MANAGER PROCESS EXIT INFO', 'HIGH', 'activity'),
(70, 'activity_lmk', 'ACTIVITY MANAGER LMK KILLS', 'CRITICAL', 'activity'),
(71, 'activity_mars', 'ACTIVITY MANAGER MARs', 'MEDIUM', 'activity'),
(72, 'activity_mars_history', 'ACTIVITY MANAGER MARs HISTORY', 'LOW', 'activity'),
(73, 'activity_filter_history', 'ACTIVITY MANAGER FILTER HISTORY', 'LOW', 'activity'),
(74, 'activity_freecess', 'ACTIVITY MANAGER Freecess', 'LOW', 'activity'),
(75, 'activity_pds', 'ACTIVITY MANAGER PDS', 'LOW', 'activity'),
(76, 'activity_pds_history', 'ACTIVITY MANAGER PDS HISTORY', 'LOW', 'activity'),
(77, 'activity_processes', 'ACTIVITY MANAGER RUNNING PROCESSES', 'HIGH', 'activity'),
(78, 'activity_users', 'ACTIVITY MANAGER USERS', 'MEDIUM', 'activity'),
(79, 'activity_component_alias', 'ACTIVITY MANAGER COMPONENT-ALIAS', 'LOW', 'activity'),
(80, 'activity_content_dispatcher', 'ACTIVITY MANAGER CONTENT_DISPATCHER', 'MEDIUM', 'activity')
"""

# Domain, focus, pattern, name of the threshold and its value.
KNOWLEDGE = (
    ("system_services", "performance", r"(?:ANR in)|(?:slow operation)|(?:timeout)|(?:blocked on)|(?:waited too long)", None, None),
    ("system_services", "lifecycle", r"(?:onStartCommand)|(?:onBind)|(?:onDestroy)|(?:Service record)", None, None),
    ("system_services", "memory", r"(?:LowMemoryKiller)|(?:OOM)|(?:out of memory)|(?:kill process)", None, None),
    ("kernel", "performance", r"(?:CPU.*stuck)|(?:rcu_preempt)|(?:softlockup)|(?:hung_task)", None, None),
    ("kernel", "power", r"(?:suspend)|(?:resume)|(?:wakeup_source)|(?:pm_runtime)", None, None),
    ("kernel", "memory", r"(?:Out of memory)|(?:Kill process)|(?:page allocation)|(?:slab)", None, None),
    ("native_services", "crash", r"(?:signal 11)|(?:SIGSEGV)|(?:SIGABRT)|(?:fault addr)", None, None),
    ("native_services", "performance", r"(?:slow dispatch)|(?:binder thread)|(?:timeout)", None, None),
    ("binder", "performance", r"(?:binder thread.*blocked)|(?:transaction.*timeout)|(?:oneway.*failed)|(?:binder.*failed)", None, None),
    ("binder", "deadlock", r"(?:deadlock)|(?:circular)|(?:waiting for lock)", None, None),
    ("performance", "launch", r"(?:Displayed.*com\..*:.+ms)|(?:TotalTime:)|(?:Startup duration)", None, None),
    ("performance", "launch", r"(?:Displayed.*com\..*:.+ms)|(?:TotalTime:)|(?:Startup duration)", "cold_start", 5000),
    ("performance", "launch", r"(?:Displayed.*com\..*:.+ms)|(?:TotalTime:)|(?:Startup duration)", "warm_start", 2000),
    ("performance", "launch", r"(?:Displayed.*com\..*:.+ms)|(?:TotalTime:)|(?:Startup duration)", "hot_start", 500),
    ("performance", "frames", r"(?:Choreographer.*skipped)|(?:jank.*count)|(?:SF.*frame miss)|(?:vsync.*late)", "jank_count", 5),
    ("performance", "frames", r"(?:Choreographer.*skipped)|(?:jank.*count)|(?:SF.*frame miss)|(?:vsync.*late)", "serious_jank", 100),
    ("performance", "binder", r"(?:binder.*took.*ms)|(?:Slow operation)|(?:binder call duration)", "slow_binder", 50),
    ("performance", "binder", r"(?:binder.*took.*ms)|(?:Slow operation)|(?:binder call duration)", "very_slow", 200),
    ("performance", "locks", r"(?:waiting to lock)|(?:blocked on)|(?:monitor contention)", None, None),
    ("performance", "locks", r"(?:waiting to lock)|(?:blocked on)|(?:monitor contention)", "lock_wait", 100),
    ("background_control", "processes", r"(?:Background kill)|(?:trim memory)|(?:app idle)|(?:standby bucket)", None, None),
    ("background_control", "limits", r"(?:Background restriction)|(?:App Standby)|(?:Doze mode)|(?:App freezer)", None, None),
    ("background_control", "priority", r"(?:oom_adj)|(?:setAdj)|(?:Process priority)|(?:sched_group)", None, None),
    ("animation_jank", "choreographer", r"(?:Choreographer.*skipped.*frames)|(?:doFrame.*took)|(?:vsync.*missed)", None, None),
    ("animation_jank", "surfaceflinger", r"(?:SF.*missed frame)|(?:BufferQueue.*dropped)|(?:GPU.*composited)", None, None),
    ("animation_jank", "renderthread", r"(?:RenderThread.*took)|(?:drawFrame.*ms)|(?:eglSwapBuffers)", None, None),
    ("animation_jank", "launcher", r"(?:Launcher.*jank)|(?:Recents.*jank)|(?:Transition.*delayed)", None, None),
    ("power_consumption", "wakelocks", r"(?:WakeLock.*held)|(?:Partial wake lock)|(?:wakelock.*timeout)", None, None),
    ("power_consumption", "battery", r"(?:BatteryHistory)|(?:Signal strength)|(?:Wifi scan)|(?:Radio active)", None, None),
    ("power_consumption", "background", r"(?:Background battery)|(?:Wakeups)|(?:Alarm.*triggered)", None, None),
)
