"""Term lists, patterns and lookup tables of the record analyses."""

# Results depend on each entry and on the order given.

VR_TERMS = ['virtual reality', 'virtual environment', 'virtual world', ' vr ', 'head-mounted display', ' hmd ', 'oculus', 'htc vive', ' vive ', 'oculus rift',
 'oculus quest', 'cave automatic', ' cave ', 'stereoscopic', '360 video', '360° video', '360-degree video', ' ive ', ' cve ']
AR_TERMS = ['augmented reality', ' ar ', 'smart glasses', 'google glass', 'epson moverio', 'heads-up display', ' hud ', 'marker-based', 'marker-less',
 'mobile ar', 'ar application', 'ar-based']
MR_TERMS = ['mixed reality', ' mr ', 'hololens', 'magic leap', 'windows mixed reality', 'spatial computing']
XR_TERMS = ['extended reality', ' xr ']
EXCLUSION_TERMS = ['agent-mediated', 'multi-agent', 'auction mechanism', 'negotiation protocol', 'market mechanism', 'mixed integer programming',
 'mixed integer linear', 'mixed integer nonlinear']
HARDWARE_TERMS = ['hololens', 'magic leap', 'oculus', 'htc vive', 'head-mounted display', ' hmd ', 'quest ', 'microsoft hololens']
CATEGORIES = ['VR', 'AR', 'MR', 'XR', 'Hybrid/Multi-technology']
TECHNICAL_TERMS = ['system design', 'system architecture', 'hardware', 'framework design', 'implementation', 'interface design', 'prototype', 'software development',
 'rendering', 'tracking', 'latency', 'haptic', '3d modeling', 'simulation engine', 'network protocol', 'bandwidth', 'fps', 'frame rate',
 'calibration', 'sensor', 'depth camera', 'point cloud', 'motion capture', 'eye tracking', 'hand tracking']
PEDAGOGICAL_TERMS = ['learning', 'education', 'teaching', 'instruction', 'curriculum', 'pedagogy', 'student', 'classroom', 'assessment', 'feedback', 'engagement',
 'motivation', 'collaboration', 'cognitive load', 'knowledge acquisition', 'training', 'e-learning', 'blended learning', 'higher education', 'k-12',
 'constructivism', 'problem-based', 'project-based', 'inquiry-based', 'self-regulated', 'metacognition', 'comprehension', 'retention',
 'academic performance']
CLASSIFICATION_FIELDS = ['Title', 'Abstract', 'Author Keywords', 'Index Keywords']
SCREEN_FIELDS = ['Title', 'Abstract', 'Author Keywords']
SCREEN_STATUS = {True: 'Included — education/training cue detected', False: 'Excluded — no qualifying education/training cue'}
EDUCATION_PATTERNS = {'education/educational': '\\beducation(?:al)?\\b',
 'teaching': '\\bteaching\\b',
 'teacher(s)': '\\bteachers?\\b',
 'instruction/instructional': '\\binstruction(?:al)?\\b',
 'curriculum/curricula': '\\bcurricul(?:um|a)\\b',
 'pedagogy/pedagogical': '\\bpedagog(?:y|ical)\\b',
 'student(s)': '\\bstudents?\\b',
 'learner(s)': '\\blearners?\\b',
 'classroom(s)': '\\bclassrooms?\\b',
 'school(s)': '\\bschools?\\b',
 'course(s)': '\\bcourses?\\b',
 'training': '\\btraining\\b',
 'trainee(s)': '\\btrainees?\\b',
 'resident(s)': '\\bresidents?\\b',
 'medical education': '\\bmedical education\\b',
 'nursing education': '\\bnursing education\\b',
 'health professions education': '\\bhealth professions education\\b',
 'clinical education': '\\bclinical education\\b',
 'learning outcome(s)': '\\blearning outcomes?\\b',
 'learning performance': '\\blearning performance\\b',
 'learning gain(s)': '\\blearning gains?\\b',
 'learning experience': '\\blearning experience\\b',
 'learning environment': '\\blearning environment\\b',
 'learning objective(s)': '\\blearning objectives?\\b',
 'knowledge acquisition': '\\bknowledge acquisition\\b',
 'skill(s) acquisition': '\\bskills? acquisition\\b',
 'professional development': '\\bprofessional development\\b',
 'resident training': '\\bresident training\\b'}
CLINICAL_PATTERNS = {'diagnosis/diagnostic': '\\bdiagnos(?:is|tic)\\b',
 'treatment': '\\btreatment\\b',
 'therapy': '\\btherapy\\b',
 'rehabilitation': '\\brehabilitation\\b',
 'patient care': '\\bpatient care\\b',
 'patient outcome(s)': '\\bpatient outcomes?\\b',
 'surgical planning': '\\bsurgical planning\\b',
 'treatment planning': '\\btreatment planning\\b',
 'intraoperative': '\\bintraoperative\\b',
 'preoperative planning': '\\bpreoperative planning\\b',
 'surgery planning': '\\bsurgery planning\\b'}
MACHINE_LEARNING_PATTERNS = ['\\bmachine learning\\b', '\\bdeep learning\\b', '\\btraining data\\b', '\\btraining dataset\\b', '\\btraining set\\b',
 '\\btrain(?:ing)? the model\\b']
GENERIC_LEARNING_LABELS = ['training', 'learning performance', 'learning gain(s)']
THEMATIC_TERMS = ['virtual reality', 'augmented reality', 'mixed reality', 'extended reality', ' vr ', ' ar ', ' xr ', ' mr ', 'hololens', 'oculus', 'head-mounted',
 'immersive environment', 'immersive simulation', '360 video', '360° video', 'stereoscopic']
ESSENTIAL_FIELDS = ['Title', 'Year', 'Source title']
COMPLETENESS_FIELDS = ['Title', 'Year', 'Source title', 'DOI', 'Abstract', 'Author Keywords', 'Index Keywords', 'Affiliations', 'Cited by', 'EID', 'Author(s) ID']
YEAR_RANGE = (1991, 2025)
COUNTRY_ALIASES = {'united states': 'USA',
 'united states of america': 'USA',
 'usa': 'USA',
 'u.s.a.': 'USA',
 'us': 'USA',
 'united kingdom': 'UK',
 'uk': 'UK',
 'great britain': 'UK',
 'russian federation': 'Russia',
 'viet nam': 'Vietnam',
 'korea, republic of': 'South Korea',
 'republic of korea': 'South Korea',
 'hong kong': 'Hong Kong',
 'macao': 'Macao',
 'taiwan': 'Taiwan'}
COUNTRY_ORDER = ['USA', 'China', 'UK', 'Spain', 'Taiwan', 'South Korea', 'Germany', 'Australia', 'Canada', 'Italy', 'Japan', 'France']
#: Whole words, in any case, and their replacements; later ones see what earlier ones wrote.
AFFILIATION_NAMES = {'MIT': 'Massachusetts Institute of Technology',
 'Stanford Univ': 'Stanford University',
 'UCLA': 'University of California, Los Angeles',
 'UCSB': 'University of California, Santa Barbara',
 'UCSD': 'University of California, San Diego',
 'UCSF': 'University of California, San Francisco',
 'UC Berkeley': 'University of California, Berkeley',
 'CMU': 'Carnegie Mellon University',
 'NYU': 'New York University',
 'USC': 'University of Southern California',
 'GT': 'Georgia Institute of Technology',
 'Georgia Tech': 'Georgia Institute of Technology',
 'UW': 'University of Washington',
 'U Washington': 'University of Washington',
 'Ohio State': 'The Ohio State University',
 'Penn State': 'Pennsylvania State University',
 'Mayo Clin': 'Mayo Clinic',
 'UCL': 'University College London',
 'KCL': "King's College London",
 'LSE': 'London School of Economics and Political Science',
 'Imperial Coll': 'Imperial College London',
 'Univ Coll London': 'University College London',
 'Univ College London': 'University College London',
 'Oxford Univ': 'University of Oxford',
 'Cambridge Univ': 'University of Cambridge',
 'Univ Edinburgh': 'University of Edinburgh',
 'Univ Manchester': 'University of Manchester',
 'Univ Nottingham': 'University of Nottingham',
 'Univ Sheffield': 'University of Sheffield',
 'Univ Leeds': 'University of Leeds',
 'UPM': 'Universidad Politécnica de Madrid',
 'UPV': 'Universitat Politècnica de València',
 'UAM': 'Universidad Autónoma de Madrid',
 'UAB': 'Universitat Autònoma de Barcelona',
 'UB': 'Universitat de Barcelona',
 'UGR': 'Universidad de Granada',
 'US': 'Universidad de Sevilla',
 'UCM': 'Universidad Complutense de Madrid',
 'UOC': 'Universitat Oberta de Catalunya',
 'PKU': 'Peking University',
 'Tsinghua Univ': 'Tsinghua University',
 'ZJU': 'Zhejiang University',
 'SJTU': 'Shanghai Jiao Tong University',
 'Fudan Univ': 'Fudan University',
 'HUST': 'Huazhong University of Science and Technology',
 'NJU': 'Nanjing University',
 'SCU': 'Sichuan University',
 'ETH Zurich': 'ETH Zürich',
 'ETH Zürich': 'ETH Zürich',
 'EPFL': 'École Polytechnique Fédérale de Lausanne',
 'KU Leuven': 'Katholieke Universiteit Leuven',
 'TU Delft': 'Delft University of Technology',
 'TU Munich': 'Technical University of Munich',
 'TUM': 'Technical University of Munich',
 'LMU': 'Ludwig Maximilian University of Munich',
 'Charité': 'Charité – Universitätsmedizin Berlin',
 'Wageningen Univ': 'Wageningen University & Research',
 'Karolinska': 'Karolinska Institutet',
 'Univ Tokyo': 'University of Tokyo',
 'Tokyo Univ': 'University of Tokyo',
 'Osaka Univ': 'Osaka University',
 'Univ Toronto': 'University of Toronto',
 'McGill Univ': 'McGill University',
 'UBC': 'University of British Columbia',
 'ANU': 'Australian National University',
 'UNSW': 'University of New South Wales',
 'Univ Melbourne': 'University of Melbourne',
 'Univ Sydney': 'University of Sydney',
 'Univ Queensland': 'University of Queensland'}
INSTITUTION_ALIASES = {'University of Toronto': ('university of toronto', 'univ of toronto'),
 'University of Washington': ('university of washington', 'univ. of washington'),
 'Harvard University': ('harvard university', 'harvard medical school'),
 'Stanford University': ('stanford university',),
 'Massachusetts Institute of Technology (MIT)': ('massachusetts institute of technology', 'massachusetts institute'),
 'Imperial College London': ('imperial college london',),
 'Københavns Universitet': ('københavns universitet', 'university of copenhagen', 'copenhagen university hospital'),
 'Rigshospitalet': ('rigshospitalet',)}
UNIVERSITY_MARKERS = ['university', 'universit', 'universidad', 'università', 'universidade', 'universität', 'universiteit', 'universitet']
ORGANISATION_MARKERS = ['hospital', 'institute', 'institut', 'clinic', 'medical center', 'medical centre', 'research center', 'research centre', 'academy']
GENERIC_LABELS = ['university', 'the university', 'national', 'college', 'school', 'hospital', 'institute', 'institut', 'clinic', 'academy', 'center', 'centre', 'medical center', 'medical centre']
SUB_UNIT_WORDS = ['department', 'school', 'college', 'faculty', 'division', 'centre', 'center', 'unit', 'laboratory', 'lab']
ATTACHED_UNIT_WORDS = ['school', 'college', 'faculty', 'department', 'division']
DISPLAY_INSTITUTIONS = {'la jolla': 'UC San Diego (USA)',
 'san diego': 'UC San Diego (USA)',
 'ucsd': 'UC San Diego (USA)',
 'ann arbor': 'Univ. of Michigan (USA)',
 'ithaca': 'Cornell Univ. (USA)',
 'harvard': 'Harvard Univ. (USA)',
 'stanford': 'Stanford Univ. (USA)',
 'washington': 'Univ. of Washington (USA)',
 'mit': 'MIT (USA)',
 'massachusetts institute': 'MIT (USA)',
 'johns hopkins': 'Johns Hopkins (USA)',
 'mayo clinic': 'Mayo Clinic (USA)',
 'university college london': 'UCL (UK)',
 'imperial college': 'Imperial College (UK)',
 'oxford': 'Univ. of Oxford (UK)',
 'cambridge': 'Univ. of Cambridge (UK)',
 'toronto': 'Univ. of Toronto (CAN)',
 'tsinghua': 'Tsinghua Univ. (CHN)',
 'nanyang': 'Nanyang Tech. Univ. (SGP)',
 'nus': 'National Univ. Singapore (SGP)',
 'hong kong polytechnic': 'HK PolyU (HKG)',
 'tokyo': 'Univ. of Tokyo (JPN)',
 'munich': 'Tech. Univ. Munich (DEU)',
 'barcelona': 'Univ. de Barcelona (ESP)',
 'seville': 'Univ. de Sevilla (ESP)',
 'sevilla': 'Univ. de Sevilla (ESP)',
 'michigan': 'Univ. of Michigan (USA)',
 'zhejiang': 'Zhejiang Univ. (CHN)',
 'cornell': 'Cornell Univ. (USA)'}
DISPLAY_TARGETS = ['university', 'universidad', 'institute', 'hospital', 'clinic', 'foundation']
KEYWORD_MAP = {'virtual reality (vr)': 'virtual reality',
 'vr': 'virtual reality',
 'augmented reality (ar)': 'augmented reality',
 'ar': 'augmented reality',
 'elearning': 'e-learning',
 'e learning': 'e-learning',
 'electronic learning': 'e-learning',
 'student': 'students',
 'mixed reality (mr)': 'mixed reality',
 'mr': 'mixed reality',
 'extended reality (xr)': 'extended reality',
 'xr': 'extended reality',
 'computer aided instruction': 'computer-aided instruction',
 'learning system': 'learning systems',
 'simulation': 'simulations'}
INDEX_KEYWORD_MAP = {'human': 'humans'}
NOT_AUTHORS = ['journal', 'international', 'proceedings', 'annual', 'education', 'review', 'medicine', 'medical', 'research', 'science', 'technology', 'computer',
 'virtual', 'reality', 'learning', 'conference', 'american', 'european', 'world', 'springer', 'elsevier', 'ieee', 'acm']
EDUCATION_SIGNALS = ['education', 'educational', 'learning', 'teaching', 'student', 'curriculum', 'pedagogy', 'school', 'university', 'training']
HEALTH_SIGNALS = ['health', 'medical', 'clinical', 'nursing', 'surgery', 'surgical', 'patient', 'hospital', 'healthcare', 'medicine']
MILESTONES = {'VR': [(2012, 'Oculus Kickstarter'), (2015, 'Samsung Gear VR'), (2016, 'Oculus/Vive/PSVR'), (2019, 'Meta Quest / Valve Index'),
        (2024, 'Apple Vision Pro')],
 'AR': [(2008, 'HTC Dream (Wikitude)'), (2012, 'Oculus Kickstarter'), (2013, 'Google Glass'), (2016, 'Pokémon GO'), (2024, 'Apple Vision Pro')],
 'MR': [(2016, 'HoloLens Dev'), (2024, 'Apple Vision Pro')],
 'XR': [(2012, 'Oculus Kickstarter'), (2024, 'Apple Vision Pro')],
 'Hybrid/Multi-technology': []}
#: What counts as missing in a delimited file.
MISSING = ['', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null']
