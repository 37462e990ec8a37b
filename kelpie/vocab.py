"""Domain vocabularies. All are defaults that callers can replace."""

from __future__ import annotations

# They must be as they are for results to agree.

ENTITY_TYPES = (
    "Register", "Pin", "Protocol", "Peripheral", "Component", "Module", "Signal", "Parameter", "Interface", "Software", "Package", "Topic", "Node", "Microcontroller", "Document",
)
DEFAULT_ENTITY_TYPE = "Component"
RELATION_TYPES = (
    "IS_TYPE", "BELONGS_TO", "PART_OF", "HAS_PIN", "HAS_VALUE", "HAS_PARAMETER", "CONNECTS_TO", "COMMUNICATES_VIA", "IMPLEMENTS", "CONTROLS", "READS", "WRITES", "PUBLISHES_TO", "SUBSCRIBES_TO", "REQUIRES",
    "GENERATES", "OPERATES_AT", "INTERFACES_WITH", "CONFIGURED_BY", "TRIGGERED_BY", "RELATED_TO",
)
DEFAULT_RELATION_TYPE = "RELATED_TO"

#: Entity type: the raw types (lower case) that mean it.
TYPE_ALIASES = {
    "Register": ("register", "control register", "status register", "data register", "sfr", "special function register", "memory mapped register", "io register", "i/o register", "configuration register"),
    "Pin": ("pin", "gpio", "gpio pin", "digital pin", "analog pin", "io pin", "i/o pin", "port pin", "output pin", "input pin", "pwm pin"),
    "Protocol": ("protocol", "communication protocol", "bus protocol", "serial protocol", "wireless protocol", "i2c", "spi", "uart", "usart", "can", "pwm", "one-wire", "i2s"),
    "Peripheral": (
        "peripheral", "on-chip peripheral", "timer", "timer/counter", "counter", "adc", "analog to digital", "analog-to-digital", "dac", "watchdog", "watchdog timer", "wdt", "comparator", "analog comparator",
        "eeprom", "flash", "sram",
    ),
    "Microcontroller": ("microcontroller", "mcu", "microprocessor", "processor", "cpu", "avr", "avr microcontroller", "chip"),
    "Component": (
        "ic", "integrated circuit", "component", "hardware", "hardware component", "electronic component", "device", "sensor", "actuator", "motor", "servo", "robot", "board", "shield", "concept",
    ),
    "Module": ("module", "driver", "motor driver", "h-bridge", "voltage regulator", "ldo", "ldo regulator", "power module"),
    "Signal": ("signal", "clock signal", "interrupt", "interrupt signal", "clock", "reset", "output signal", "input signal", "waveform"),
    "Parameter": ("parameter", "specification", "value", "frequency", "voltage", "current", "speed", "resolution", "baud rate", "bit rate", "duty cycle", "prescaler"),
    "Interface": ("interface", "connector", "header", "port", "bus", "usb", "usb port", "serial port", "icsp", "jtag"),
    "Software": (
        "software", "firmware", "library", "sketch", "code", "program", "script", "driver software", "api", "framework", "middleware", "os", "operating system", "rtos",
    ),
    "Package": ("package", "ros package", "catkin package"),
    "Topic": ("topic", "ros topic", "message", "ros message"),
    "Node": ("node", "ros node", "nodelet"),
    "Document": ("document", "datasheet", "manual", "user manual", "reference manual", "wiki"),
}

#: Keywords in order; the first that a raw type contains decides.
TYPE_KEYWORDS = (
    ("register", "Register"), ("pin", "Pin"), ("gpio", "Pin"), ("timer", "Peripheral"), ("counter", "Peripheral"), ("adc", "Peripheral"), ("dac", "Peripheral"), ("usart", "Protocol"), ("uart", "Protocol"),
    ("protocol", "Protocol"), ("spi", "Protocol"), ("i2c", "Protocol"), ("pwm", "Protocol"), ("microcontroller", "Microcontroller"), ("processor", "Microcontroller"), ("mcu", "Microcontroller"),
    ("signal", "Signal"), ("interrupt", "Signal"), ("clock", "Signal"), ("voltage", "Parameter"), ("current", "Parameter"), ("frequency", "Parameter"), ("baud", "Parameter"), ("interface", "Interface"),
    ("connector", "Interface"), ("port", "Interface"), ("software", "Software"), ("firmware", "Software"), ("library", "Software"), ("package", "Package"), ("topic", "Topic"), ("node", "Node"),
    ("driver", "Module"), ("bridge", "Module"), ("regulator", "Module"), ("document", "Document"), ("datasheet", "Document"), ("manual", "Document"), ("sensor", "Component"), ("actuator", "Component"),
    ("motor", "Component"), ("robot", "Component"), ("module", "Module"),
)

#: Relation type: the normalised raw relations that mean it.
RELATION_ALIASES = {
    "IS_TYPE": ("IS_A", "IS_AN", "IS_TYPE_OF", "TYPE_OF", "DEFINED_AS", "IS_DEFINED_AS"),
    "HAS_PARAMETER": ("HAS", "HAS_PROPERTY", "HAS_ATTRIBUTE", "HAS_SPEC", "HAS_SPECIFICATION", "HAS_FEATURE", "HAS_MEMORY"),
    "PART_OF": ("CONTAINS", "INCLUDED_IN", "COMPONENT_OF", "SUBSET_OF", "HAS_PERIPHERAL"),
    "COMMUNICATES_VIA": ("USES", "USES_PROTOCOL", "COMMUNICATES_WITH"),
    "CONNECTS_TO": ("CONNECTS", "CONNECTED_TO", "WIRED_TO", "LINKED_TO"),
    "CONTROLS": ("CONTROLS_VIA", "DRIVES", "MANAGES", "OPERATES"),
    "READS": ("READS_FROM", "RECEIVES_FROM", "RECEIVES"),
    "WRITES": ("WRITES_TO", "SENDS_TO", "SENDS", "TRANSMITS"),
    "PUBLISHES_TO": ("PUBLISHES", "PUBLISHED_TO"),
    "SUBSCRIBES_TO": ("SUBSCRIBES",),
    "REQUIRES": ("DEPENDS_ON", "NEEDS", "NEEDS_LIBRARY"),
    "GENERATES": ("PRODUCES", "OUTPUTS", "GENERATES_SIGNAL"),
    "OPERATES_AT": ("RUNS_AT", "CLOCKED_AT", "POWERED_BY"),
    "CONFIGURED_BY": ("CONFIGURED_VIA", "SET_BY"),
    "TRIGGERED_BY": ("ACTIVATED_BY", "ENABLED_BY", "TRIGGERED_VIA"),
    "INTERFACES_WITH": ("INTERFACES", "INTERACTS_WITH", "WORKS_WITH"),
    "HAS_PIN": ("EQUIPPED_WITH", "HAS_CHANNEL", "HAS_PWM_PIN", "IS_EQUIPPED_WITH"),
    "RELATED_TO": ("RELATED_TO",),
}

#: Hardware identifiers (whole name, any case).
PROTECTED = (
    "ADC[0-7]", "Timer[0-9]", "TC[0-9]", "OC[0-9][AB]", "OCR[0-9][AB]?", "TCCR[0-9][AB]", "TCNT[0-9]", "ICR[0-9]", "D[0-9]{1,2}", "A[0-7]", "INT[0-9]", "PCINT[0-9]{1,2}", "(MOSI|MISO|SCK|SS)", "(SDA|SCL)",
    "(TX|RX|TXD|RXD)", "(DDR|PORT|PIN)[A-F]", "(ADMUX|ADCSRA|ADCSRB|ADCL|ADCH)", "(SREG|SPH|SPL|EECR|EEDR|EEARL|EEARH)", "(MCUCR|MCUSR|SMCR|PRR)", "(WDTCSR|CLKPR|OSCCAL|RCSTA)",
)

NAME_STOPWORDS = (
    "system", "it", "this", "that", "the", "a", "an", "and", "or", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "shall", "can", "thing", "things", "item", "items", "data", "value", "values", "type", "types", "mode", "modes", "function", "functions", "feature", "features", "property", "properties",
    "operation", "operations", "example", "examples", "user", "users", "output", "input", "method", "methods", "process", "processes", "result", "results", "information", "description", "text", "number",
    "bit", "byte", "word", "hardware", "software", "concept",
)

TECHNICAL_TERMS = (
    "i2c", "spi", "uart", "pwm", "sda", "scl", "mosi", "miso", "sck", "gpio", "adc", "dac", "rosserial", "tcp", "udp", "mqtt", "pid", "a4", "a5", "d9", "d10", "d11", "a0", "a1", "a2",
)
HUB_TERMS = ("arduino", "ros", "atmel", "atmega", "usb", "can")
QUERY_STOPWORDS = (
    "how", "does", "what", "is", "the", "a", "an", "and", "or", "to", "in", "of", "for", "with", "can", "do", "i", "me", "give", "using", "use", "used", "about", "explain",
)
LEXICAL_KEEP = ("i2c", "spi", "pwm", "ros", "sda", "scl", "vin", "a4", "a5", "d9", "d10", "d11", "ss", "rx", "tx")

#: Term in a query: parts of the names of sources that answer it.
SOURCE_HINTS = {
    "rosserial": ("rosserial - ROS Wiki", "Programming"), "ros": ("Programming",), "l298n": ("L298N",), "l298": ("L298N",), "motor driver": ("L298N",), "h-bridge": ("L298N",), "i2c": ("I2C", "ARDUINO"),
    "kuka": ("KUKA",), "atmega": ("Atmel", "ARDUINO"), "timer": ("Atmel", "ARDUINO"), "adc": ("Atmel", "ARDUINO"), "arduino": ("ARDUINO",), "automation": ("ROBOTICS",), "actuator": ("ROBOTICS",),
    "manipulator": ("ROBOTICS",), "pwm": ("ARDUINO", "Atmel"), "uart": ("ARDUINO",), "spi": ("ARDUINO",), "sda": ("ARDUINO",), "scl": ("ARDUINO",), "vin": ("ARDUINO",), "ldo": ("ARDUINO",),
    "nodehandle": ("rosserial - ROS Wiki",), "publisher": ("rosserial - ROS Wiki", "Programming"), "subscriber": ("rosserial - ROS Wiki", "Programming"), "cmd_vel": ("Programming",),
    "topic": ("Programming",), "sensor": ("ROBOTICS", "ARDUINO"), "robot": ("ROBOTICS",),
}

CASUAL = (
    "hi", "hello", "hey", "hiya", "howdy", "good morning", "good afternoon", "good evening", "what's up", "whats up", "sup", "how are you", "how r u", "who are you", "what are you", "what can you do", "help",
    "thanks", "thank you", "bye", "goodbye", "ok", "okay", "cool", "nice", "great",
)

# Texts of one's own: deployments word their replies themselves.
CASUAL_REPLIES = {
    "hi": "Hi! Ask me anything about your documents.", "hello": "Hello! What would you like to find out?", "hey": "Hey! What are you looking for?", "how are you": "Fine, and ready to look things up.",
    "who are you": "I answer questions from your documents and their knowledge graph.", "what are you": "A search over text, vectors and a graph, with answers that name their sources.",
    "what can you do": "I find passages and relations in your documents and answer with citations.", "thanks": "You're welcome!", "thank you": "Glad to help.", "bye": "Goodbye!", "goodbye": "Goodbye!",
    "help": "Ask a question in plain words; I cite what I find.",
}
CASUAL_DEFAULT = "Ask me a question about your documents."
