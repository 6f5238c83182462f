"""Fixed values of the correction for formal speeches."""

from __future__ import annotations

# Signs of a delegate's speech by weight. \w is a letter or digit of any script.
SPEECH_SIGNS = {
    3: [
        r"\bhello\s+delegates\b", r"\bdistinguished\s+delegates\b", r"\bhonorable\s+delegates\b", r"\bfellow\s+delegates\b", r"\bmy\s+name\s+is\s+\w+\s+and\s+i\s+am\s+representing\b",
        r"\bi\s+am\s+representing\s+\w+\b", r"\bthe\s+delegate\s+(?:from|of)\s+\w+\b", r"\byour\s+delegate\s+from\b", r"\bmodel\s+united\s+nations\b", r"\bmodel\s+un\b", r"\bmun\s+conference\b",
    ],
    2: [
        r"\bour\s+committee\b", r"\bthis\s+committee\b", r"\bcommittee\s+sessions?\b", r"\bduring\s+our\s+committee\b", r"\bposition\s+paper\b", r"\bi\s+urge\s+(?:all\s+)?delegates\b",
        r"\bwe\s+urge\s+(?:all\s+)?delegates\b", r"\bthe\s+delegation\s+of\b", r"\bproposes?\s+(?:several|the\s+following)\b", r"\bunited\s+nations\s+\w+\s+council\b",
    ],
    1: [
        r"\bmember\s+states\b", r"\b(?:this|our)\s+nation\b", r"\binternational\s+cooperation\b", r"\bglobal\s+issue\b", r"\bhumanitarian\s+(?:crisis|aid|efforts?)\b",
        r"\bcalling\s+upon\s+all\b", r"\bin\s+conclusion\b", r"\bthank\s+you\b",
    ],
}
STUDENT_SIGNS = [
    r"\bmy\s+name\s+is\b", r"\bhello,?\s+(?:my\s+name|i'?m|everyone)\b", r"\bi\s+am\s+\w+,?\s+(?:and\s+)?i\s+will\b", r"\btoday\s+i\s+(?:will|am\s+going\s+to)\b", r"\blet\s+me\s+(?:start|begin)\b",
    r"\bas\s+a\s+student\b", r"\bi\s+believe\s+that\b", r"\bin\s+my\s+opinion\b", r"\bi\s+personally\b", r"\bi\s+think\s+that\b",
]
UNCERTAIN_SIGNS = [
    r"\bperhaps\b", r"\bmaybe\b", r"\bmight\b", r"\bcould\s+be\b", r"\bi'?m\s+not\s+sure\b", r"\bi\s+guess\b", r"\bprobably\b", r"\bit\s+seems\b", r"\bappears\s+to\b", r"\bkind\s+of\b",
    r"\bsort\s+of\b", r"\ba\s+bit\b", r"\bsomewhat\b",
]
INTRODUCTION_SIGNS = [r"\bi\s+am\s+\w+[^\n]*representing\b", r"\bmy\s+name\s+is\s+\w+[^\n]*i\s+(?:am|will)\b", r"\bhello[^\n]*my\s+name\s+is\b", r"\bi'?m\s+\w+[^\n]*delegate\b"]
